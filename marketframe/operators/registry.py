"""Maintaining the ticker registry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical_ticker
from ..schemas import MAPPING_SCHEMA
from ..workspace import materialized


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING_SCHEMA)


#: Rows that one task numbers, at least while the order's sampled borders are even.
PIECE_ROWS = 2_000_000


def number_rows(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Dense 1..N numbers in the order of unique sort columns, without one task seeing all rows.

    Rows are counted, range-partitioned into pieces of about ``PIECE_ROWS``, sorted within them and
    written once with their number in the piece, so that sizes and rows come from the very same
    placement even if an executor is lost. What remains is to add the offsets of the pieces (one row
    each, summed by the only window): the rows themselves are shuffled once.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, math.ceil(df.count() / PIECE_ROWS))
    # The generated id is the piece in its upper bits and the number in the piece in its lower 33.
    generated = F.monotonically_increasing_id()
    placed = materialized(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", generated),
        "numbered",
    ).withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        placed.join(offsets, "_part")
        .withColumn(name, (F.col("offset") + within).cast("bigint"))
        .drop("_part", "_at", "offset")
    )


def new_requests(mapping: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested tickers not yet registered, each once, at the place of its first request. Repeats
    are folded on the map side before anything is joined."""
    wanted = requests.select("pos", canonical_ticker(F.col("ticker")).alias("ticker"), "name")
    first = (
        wanted.groupBy("ticker")
        .agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))
        .join(mapping.select("ticker").distinct(), "ticker", "left_anti")
    )
    return first.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "ticker"))


def next_id(mapping: DataFrame) -> DataFrame:
    """One row with the next free id."""
    return mapping.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def add_tickers(mapping: DataFrame, requests: DataFrame) -> DataFrame:
    """Registry with the requested tickers ``(pos, ticker, name)`` appended. Registered tickers
    stay as they are; new ones get the ids after the highest one, in the order of the requests, and
    their ticker as name unless one is given."""
    numbered = number_rows(new_requests(mapping, requests), "pos")
    top_id = next_id(mapping).scalar()
    top_pos = mapping.select(F.coalesce(F.max("pos") + 1, F.lit(0))).scalar()
    added = numbered.select(
        (top_pos + F.col("seq") - 1).alias("pos"),
        (top_id + F.col("seq") - 1).alias("id"),
        "name",
        "ticker",
    )
    return mapping.select("pos", "id", "name", "ticker").unionByName(added)


def resequence_entries(entries: DataFrame) -> DataFrame:
    """Ids 1..N in file order for raw entries ``(pos, entry)``: each element of the array uses up a
    number, and the position already is that number, so no shuffle is needed. ``new_id`` is null
    for elements that are not objects, which stay untouched."""
    is_object = F.try_variant_get("entry", "$", "map<string,variant>").isNotNull()
    return entries.withColumn(
        "new_id", F.when(is_object, (F.col("pos") + 1).cast("string"))
    )


def resequence(mapping: DataFrame, *order: str) -> DataFrame:
    """Ids 1..N in the order of unique sort columns (default: position), as text; ``old_id`` keeps
    the former id as the backup."""
    numbered = number_rows(mapping, *(order or ("pos",)))
    return numbered.withColumn("old_id", F.col("id")).withColumn(
        "id", F.col("seq").cast("string")
    ).drop("seq")
