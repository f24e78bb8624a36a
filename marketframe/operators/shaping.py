"""Reshaping company documents into a wide company table and a long price table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical_ticker, json_text, lax_integer
from ..functions.variants import integer_of, kind_of, number_of, string_of
from ..schemas import COMPANY_SCHEMA, EXTRA, POINT_SCHEMA, PRICE_SCHEMA

_POINT = "struct<ts: variant, value: variant, interval: variant, valueUnit: variant>"


def object_points(points: Column) -> Column:
    """Typed price points from an array of JSON values; elements that are not objects vanish. A value of
    the wrong type (any text, "Infinity" included) is null in its own field only."""
    objects = F.filter(F.transform(points, lambda e: F.try_variant_get(e, "$", _POINT)), lambda p: p.isNotNull())
    return F.transform(
        objects,
        lambda p: F.struct(
            integer_of(p["ts"]).alias("ts"),
            number_of(p["value"]).alias("value"),
            integer_of(p["interval"]).alias("interval"),
            string_of(p["valueUnit"]).alias("valueUnit"),
        ),
    )


def typed_companies(documents: DataFrame) -> DataFrame:
    """Documents as read from disk to company records: integer id, canonical ticker, empty
    collections in place of nulls, typed price points. Other columns pass through."""
    no_strings = F.array().cast("array<string>")
    no_values = F.create_map().cast("map<string,variant>")
    points = F.coalesce(
        object_points(F.col("insights.stock_price")),
        F.array().cast(T.ArrayType(POINT_SCHEMA)),
    )
    return documents.withColumns(
        {
            "id": lax_integer(F.col("id").cast("string")),
            "ticker": canonical_ticker(F.col("ticker")),
            "indices": F.coalesce("indices", no_strings),
            "exchanges": F.coalesce("exchanges", no_strings),
            "aggregations": F.coalesce("aggregations", no_values),
            "insights": F.struct(points.alias("stock_price")),
            "lastUpdated": F.coalesce("lastUpdated", no_values),
            EXTRA: F.coalesce(EXTRA, no_values) if EXTRA in documents.columns else no_values,
        }
    )


def company_details(companies: DataFrame) -> DataFrame:
    """Everything but the price insights."""
    return companies.drop("insights")


def unnest_prices(companies: DataFrame) -> DataFrame:
    """One row per price point with its position in the array; no points, no rows."""
    return companies.select(
        F.col("id").alias("company_id"),
        "ticker",
        F.posexplode("insights.stock_price").alias("pos", "point"),
    ).select("company_id", "ticker", "point.*", F.col("pos").cast("bigint").alias("pos"))


def empty_prices(spark: SparkSession) -> DataFrame:
    """The typed price table without rows."""
    return spark.createDataFrame([], PRICE_SCHEMA)


def prices_with_fallback(
    file_prices: DataFrame, companies: DataFrame
) -> DataFrame:
    """Prices of the separate price table where a ticker has any there, else the points embedded
    in its company document. Documents are sorted out before their points are unnested, so only
    one row per document takes part in the join."""
    covered = file_prices.select("ticker").distinct()
    embedded = unnest_prices(companies.join(covered, "ticker", "left_anti"))
    return file_prices.unionByName(embedded, allowMissingColumns=True)


def _reject_collisions(df: DataFrame, replaced: str, names: Iterable[str]) -> None:
    taken = {c.lower() for c in df.columns if c != replaced}
    clash = []
    for name in sorted(names):
        if name.lower() in taken:
            clash.append(name)
        taken.add(name.lower())
    if clash:
        raise ValueError(f"flattening {replaced!r} would repeat columns: {clash}")


def _narrowest(kinds: set[str], long: bool) -> str:
    """The narrowest column type that holds values of these JSON kinds unchanged."""
    kinds = kinds - {"null"}
    if not kinds:  # no value at all
        return "double"
    if kinds == {"boolean"}:
        return "boolean"
    if kinds == {"integer"}:
        return "bigint"
    return "double" if kinds <= {"integer", "number"} and not long else "string"


def _text_kind(value: Column) -> Column:
    """The JSON kind that a plain text looks like."""
    whole = value.rlike(r"^-?(?:0|[1-9][0-9]{0,18})$") & value.try_cast("bigint").isNotNull()
    number = value.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")
    return (
        F.when(value.isNull(), "null")
        .when(whole, "integer")
        .when(value.isin("true", "false"), "boolean")
        .when(number, "number")
        .otherwise("string")
    )


def value_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, str]]:
    """For every map column the keys, sorted, with the narrowest type that holds all their values:
    ``bigint``, ``boolean``, ``double`` or, where any of those would change a value, ``string``.

    Kinds are those of the JSON values, so the text ``"12"`` stays text; in a map of plain texts they are
    what the texts look like. One aggregation for all columns, which combines before its shuffle; the
    result is one entry per output column of a wide table. Where that is too wide, use
    :func:`long_metrics`.
    """
    entries = None
    for column in columns:
        value = F.col("value")
        if isinstance(df.schema[column].dataType.valueType, T.VariantType):
            kind = F.coalesce(kind_of(value), F.lit("null"))
            whole = F.try_variant_get(value, "$", "bigint")
            long = F.when(kind == "integer", (whole > 2**53) | (whole < -(2**53)))
        else:
            kind = _text_kind(value.cast("string"))
            long = (kind == "integer") & (F.length(value.cast("string")) > 15)
        pairs = df.select(F.explode(column).alias("name", "value"))
        part = pairs.select(F.lit(column).alias("column"), "name", kind.alias("kind"), long.alias("long"))
        entries = part if entries is None else entries.unionByName(part)
    found = entries.groupBy("column", "name").agg(F.collect_set("kind").alias("kinds"), F.bool_or("long").alias("long")).collect()
    types: dict[str, dict[str, str]] = {column: {} for column in columns}
    for r in sorted(found, key=lambda r: r["name"]):
        types[r["column"]][r["name"]] = _narrowest({"string" if k in ("object", "array", "strings") else k for k in r["kinds"]}, r["long"])
    return types


def metric_types(df: DataFrame, column: str) -> dict[str, str]:
    """The keys and types of one map column, as ``value_kinds`` finds them."""
    return value_kinds(df, [column])[column]


def _as_type(value: Column, kind: str | None, held: T.DataType) -> Column:
    """A map's value as a column of the given type, else as text."""
    if not isinstance(held, T.VariantType):
        return value.try_cast(kind) if kind else value
    return F.try_variant_get(value, "$", kind or "string")


def metric_names(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct keys of a map column, which become a list of output columns."""
    names = df.select(F.explode(F.map_keys(column)).alias("name")).distinct().collect()
    return sorted(r["name"] for r in names)


def long_metrics(df: DataFrame, column: str = "aggregations") -> DataFrame:
    """``(ticker, metric, value string)``: one row per key, for any number of different keys."""
    return df.select("ticker", F.explode(column).alias("metric", "value"))


def flatten(
    df: DataFrame,
    column: str,
    prefix: str = "",
    keys: Sequence[str] | Mapping[str, str] | None = None,
    value_type: str | None = None,
) -> DataFrame:
    """Replace a struct or map column by one column per key (``prefix_key`` when prefixed). ``keys``
    may give each key's type; ``value_type`` is that of keys without one.

    Struct fields keep their order and types; map keys come out sorted. Absent keys and null
    containers give nulls. A name that is already taken raises ``ValueError``.
    """
    if column not in df.columns:
        return df
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StructType):
        names = list(keys) if keys is not None else dtype.fieldNames()
    else:
        names = list(keys) if keys is not None else metric_names(df, column)
    out = [f"{prefix}_{n}" if prefix else n for n in names]
    _reject_collisions(df, column, out)
    flat = []
    for name, alias in zip(names, out):
        kind = keys[name] if isinstance(keys, Mapping) else value_type
        if isinstance(dtype, T.StructType):
            value = _as_type(F.col(column)[name], kind, dtype[name].dataType)
        else:
            value = _as_type(F.try_element_at(F.col(column), F.lit(name)), kind, dtype.valueType)
        flat.append(value.alias(alias))
    position = df.columns.index(column)
    others = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*others[:position], *flat, *others[position + 1 :])


def flatten_json_text(
    df: DataFrame,
    column: str,
    keys: Sequence[str],
    value_type: str = "double",
    prefix: str = "",
) -> DataFrame:
    """As :func:`flatten` for a column of JSON object texts; text that is not an object gives
    nulls, and one odd value does not disturb its neighbours."""
    parsed = df.withColumn(column, F.from_json(column, "map<string,string>"))
    return flatten(parsed, column, prefix=prefix, keys=keys, value_type=value_type)


def aligned_metrics(df: DataFrame, column: str = "aggregations") -> DataFrame:
    """One wide table over records whose metric sets differ: the union of all keys, sorted, null
    where a record lacks one. A projection, so nothing is shuffled apart from the key names."""
    return flatten(df, column, keys=metric_types(df, column))


def flattened_companies(
    companies: DataFrame,
    metrics: Sequence[str] | Mapping[str, str] | None = None,
    updates: Sequence[str] | Mapping[str, str] | None = None,
    extras: Sequence[str] | Mapping[str, str] | None = None,
) -> DataFrame:
    """Company details with metrics, update times and further fields as columns of the types that hold
    all their values; objects and arrays among them become JSON text. Keys, with their types, may be
    given to spare the pass that finds them; keys without types keep their text."""
    wide = company_details(companies)
    given = {"aggregations": metrics, "lastUpdated": updates, EXTRA: extras}
    unknown = [c for c, keys in given.items() if keys is None and c in wide.columns]
    given |= value_kinds(wide, unknown) if unknown else {}
    for column, prefix in (("aggregations", ""), ("lastUpdated", "last_updated"), (EXTRA, "")):
        wide = flatten(wide, column, prefix=prefix, keys=given[column])
    return move_to_end(wide, "description")


def stringify_nested(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats that hold flat columns only."""
    skip = set(exclude)
    nested = {
        f.name: json_text(F.col(f"`{f.name}`"), f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) and f.name not in skip
    }
    return df.withColumns(nested) if nested else df


def move_to_end(df: DataFrame, column: str = "description") -> DataFrame:
    """Put one column last; nothing happens when it is absent."""
    if column not in df.columns:
        return df
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.col(f"`{column}`"))


__all__ = [
    "COMPANY_SCHEMA",
    "aligned_metrics",
    "company_details",
    "empty_prices",
    "flatten",
    "flatten_json_text",
    "flattened_companies",
    "long_metrics",
    "metric_names",
    "metric_types",
    "move_to_end",
    "object_points",
    "prices_with_fallback",
    "stringify_nested",
    "typed_companies",
    "unnest_prices",
    "value_kinds",
]
