"""Looking at JSON values whose type is not known in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lax_integer

# The JSON texts a truth test rejects.
BLANK_JSON = ("null", "{}", "[]", '""', "0", "0.0", "-0.0", "false")

# Fixed value: JSON text up to and with a negative zero that has places, texts passed over.
_NEGATIVE_ZERO = r'(?s)\G((?:[^"-]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|-(?!0\.0++(?![0-9.eE])))*+)-0\.0++'


def parsed_json(text: Column) -> Column:
    """The VARIANT of a JSON text, or null. A negative zero such as ``-0.0`` keeps its sign: with an exponent
    VARIANT holds it as a double, without one as a decimal, which has no such value."""
    signed = F.regexp_replace(text, _NEGATIVE_ZERO, "$1-0e0")
    return F.try_parse_json(F.when(text.contains("-0.0"), signed).otherwise(text))


def member(v: Column, key: str) -> Column:
    """The value under ``key``: SQL null when the key is absent, a JSON null when it is null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def elements(v: Column) -> Column:
    """The elements of a JSON array, or SQL null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def entries(v: Column) -> Column:
    """The members of a JSON object, or SQL null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def kind_of(v: Column) -> Column:
    """``object array strings string integer number boolean null``, or SQL null when absent.

    ``strings`` is an array that holds nothing but strings, the empty one included. Containers are
    told by a shallow cast; only scalars reach ``schema_of_variant``.
    """
    tag = F.schema_of_variant(v)
    all_strings = F.forall(elements(v), lambda e: F.schema_of_variant(e) == "STRING")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(v), "null")
        .when(entries(v).isNotNull(), "object")
        .when(elements(v).isNotNull(), F.when(all_strings, "strings").otherwise("array"))
        .when(tag == "STRING", "string")
        .when(tag == "BIGINT", "integer")
        .when(tag == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def member_kinds(record: Column, names: Sequence[str]) -> Column:
    """A map from the names that are present in a JSON object to the kinds of their values."""
    known = F.map_filter(entries(record), lambda k, v: k.isin(*names))
    return F.transform_values(known, lambda k, v: kind_of(v))


def string_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def lax_integer_of(v: Column) -> Column:
    """Lax integer coercion of a JSON value: integers, integral numbers, booleans, integer text."""
    tag = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(tag == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(tag == "STRING", lax_integer(string_of(v)))
        .when(tag == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when((tag == "DOUBLE") | tag.startswith("DECIMAL"),
              F.when(number == F.floor(number), number.try_cast("bigint")))
    )


def is_blank(v: Column) -> Column:
    """True for values a truth test rejects: absent, null, ``{}``, ``[]``, ``""``, 0, false."""
    return v.isNull() | F.to_json(v).isin(*BLANK_JSON)


def kept_fraction(v: Column) -> Column:
    """A number such as ``2.0`` as a double, which is written as such again; VARIANT holds it as a decimal
    without places, which would come out as an integer. Integers of that size are BIGINT instead."""
    bare = F.schema_of_variant(v).rlike(r"^DECIMAL\((\d|1[0-5]),0\)$")
    return F.when(bare, F.try_variant_get(v, "$", "double").cast("variant")).otherwise(v)


def number_of(v: Column) -> Column:
    """The double of a JSON number; anything else, text included, is null."""
    tag = F.schema_of_variant(v)
    numeric = tag.isin("BIGINT", "DOUBLE") | tag.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def integer_of(v: Column) -> Column:
    """The bigint of a JSON integer; anything else is null."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
