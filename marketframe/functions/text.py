"""Text forms of values: tickers, lax integers, JSON text, SQL literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as whitespace around a ticker or a number.
BLANK = r"[\s\x1c-\x1f]"
# The text of an integer that lax validation accepts.
LAX_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*(\.0+)?$"


def stripped(c: Column) -> Column:
    """Remove all leading and trailing whitespace, not just spaces."""
    return F.regexp_replace(c, f"(?U)^{BLANK}+|{BLANK}+$", "")


def canonical_ticker(c: Column) -> Column:
    """Stripped and upper-cased ticker."""
    return F.upper(stripped(c))


def lax_integer(c: Column) -> Column:
    """BIGINT for text that denotes an integer (``" 7 "``, ``"1.0"``, ``"+3"``, ``"1_000"``), else null."""
    text = stripped(c)
    digits = F.regexp_replace(text, r"_|\.0+$", "")
    return F.when(text.rlike(LAX_INTEGER), digits.try_cast("bigint"))


def json_string(c: Column) -> Column:
    """A JSON string literal with every non-ASCII character as ``\\uxxxx`` (UTF-16 units)."""
    encoded = F.to_json(F.array(c))
    quoted = encoded.substr(F.lit(2), F.length(encoded) - 2)
    runs = F.regexp_extract_all(quoted, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]+"), F.lit(0))

    def escaped(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return F.when(run.rlike(r"^[\x00-\x7f]"), run).otherwise(
            F.regexp_replace(units, "(.{4})", r"\\u$1")
        )

    return F.when(
        quoted.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(runs, escaped), "")
    ).otherwise(quoted)


def number_text(c: Column) -> Column:
    """Text of a double without an exponent wherever plain digits are the usual form
    (1e-4 <= |x| < 1e16); other magnitudes keep the exponent."""
    text = c.cast("string")
    size = F.abs(c)

    def plain(scale: int) -> Column:
        digits = F.regexp_replace(
            text.try_cast(f"decimal(38,{scale})").cast("string"), r"0+$", ""
        )
        return F.regexp_replace(digits, r"\.$", ".0")

    return (
        F.when((size >= 1e7) & (size < 1e16), plain(18))
        .when((size >= 1e-4) & (size < 1e-3), plain(28))
        .otherwise(text)
    )


def json_text(c: Column, dtype: T.DataType) -> Column:
    """JSON text with ``", "`` and ``": "`` separators; a null column stays null, an inner null
    is written ``null``."""

    def inner(v: Column, t: T.DataType) -> Column:
        return F.coalesce(json_text(v, t), F.lit("null"))

    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda v: inner(v, dtype.elementType))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    if isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                json_string(e["key"].cast("string")), F.lit(": "), inner(e["value"], dtype.valueType)
            ),
        )
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    if isinstance(dtype, T.StructType):
        pairs = [
            F.concat(json_string(F.lit(f.name)), F.lit(": "), inner(c[f.name], f.dataType))
            for f in dtype.fields
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
        return F.when(c.isNotNull(), body)
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(c)
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return c.cast("string")
    return json_string(c.cast("string"))


def sql_literal(c: Column, dtype: T.DataType) -> Column:
    """A SQL literal: NULL for null and ``''``, bare numbers, 1/0 for booleans, else quoted text."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "1").when(~c, "0")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), number_text(c))
    elif isinstance(dtype, T.NumericType):
        text = c.cast("string")
    else:
        plain = c.cast("string")
        quoted = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
        text = F.when(plain != "", quoted)
    return F.coalesce(text, F.lit("NULL"))
