"""The ticker registry: an ordered JSON array of ``{id, name, ticker}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_ticker, lax_integer_of
from ..functions.variants import elements, member, string_of
from ..schemas import MAPPING_SCHEMA


# Fixed value: the error for a registry of another shape.
NO_ARRAY = "Mapping file must contain a JSON array"


def read_mapping_entries(spark: SparkSession, path: str) -> DataFrame:
    """Raw registry entries ``(pos, entry VARIANT)`` in file order; anything but an array fails."""
    root = elements(F.try_parse_json("value"))
    checked = F.when(
        root.isNull(), F.raise_error(F.lit(NO_ARRAY))
    ).otherwise(root)
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(checked).alias("pos", "entry"))
        .select(F.col("pos").cast("bigint").alias("pos"), "entry")
    )


def mapping_from_entries(entries: DataFrame) -> DataFrame:
    """Typed registry ``(pos, id, name, ticker)`` from raw entries."""
    return entries.select(
        "pos",
        lax_integer_of(member(F.col("entry"), "id")).alias("id"),
        string_of(member(F.col("entry"), "name")).alias("name"),
        canonical_ticker(string_of(member(F.col("entry"), "ticker"))).alias("ticker"),
    )


def read_mapping(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Typed registry. ``lines=True`` reads the sink's own layout, JSON lines with ``pos``, which
    splits; the array layout is a single JSON value and is parsed as one."""
    if not lines:
        return mapping_from_entries(read_mapping_entries(spark, path))
    rows = spark.read.schema("pos bigint, id string, name string, ticker string").json(path)
    return rows.select(
        "pos", F.col("id").cast("bigint").alias("id"), "name", "ticker"
    ).to(MAPPING_SCHEMA)
