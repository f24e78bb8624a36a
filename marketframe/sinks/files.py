"""File sinks.

``by_ticker=True`` lays a dataset out in one folder per ticker, and an overwrite then replaces only
the tickers in the new data. A rebalance hint gathers a ticker's rows so that it does not leave one
small file per task, and lets AQE split a hot ticker over several files. What a task costs is its
folders, not its bytes, so small partitions stay apart. For very many small tickers
leave ``by_ticker`` off: the rows then go out as they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions import number_text
from ..operators.shaping import stringify_nested
from ..schemas import EXTRA


# Merging partitions by their bytes would give all folders of small tickers to one task.
_MERGING = "spark.sql.adaptive.coalescePartitions.enabled"


@contextmanager
def layout(df: DataFrame, by_ticker: bool) -> Iterator[DataFrameWriter]:
    """A writer that replaces the whole dataset, or by ticker only the tickers in ``df``; the write by
    ticker, within the context, spreads the folders over ``spark.sql.shuffle.partitions`` tasks."""
    if not by_ticker:
        yield df.write.mode("overwrite")
        return
    conf = df.sparkSession.conf
    before = conf.get(_MERGING)
    conf.set(_MERGING, "false")
    try:
        yield (
            df.hint("rebalance", "ticker")
            .write.mode("overwrite")
            .partitionBy("ticker")
            .option("partitionOverwriteMode", "dynamic")
        )
    finally:
        conf.set(_MERGING, before)


def json_lines(df: DataFrame) -> DataFrame:
    """``df`` as JSON objects in ``value``, next to ``ticker``; what ``extra`` holds stands among the
    other fields, as it did in the document."""
    known = [F.col(f"`{c}`") for c in df.columns if c != EXTRA]
    head = F.to_json(F.struct(*known), {"ignoreNullFields": "false"})
    more = F.to_json(EXTRA)
    both = F.concat(F.left(head, F.length(head) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more)))
    return df.select(F.when(F.size(EXTRA) > 0, both).otherwise(head).alias("value"), "ticker")


def write_json(df: DataFrame, path: str, by_ticker: bool = False) -> None:
    """JSON lines, which Spark can split again. Numbers and other JSON values stay what they are."""
    if EXTRA in df.columns:
        lines = json_lines(df)
        with layout(lines if by_ticker else lines.select("value"), by_ticker) as writer:
            writer.text(path)
    else:
        with layout(df, by_ticker) as writer:
            writer.option("ignoreNullFields", False).json(path)


def plain_numbers(df: DataFrame) -> DataFrame:
    """Doubles as text without needless exponents."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: number_text(F.col(f"`{c}`")) for c in doubles}) if doubles else df


def write_csv(df: DataFrame, path: str, by_ticker: bool = False) -> None:
    """CSV with a header; nested columns as JSON text, quotes doubled. An empty table still
    overwrites what was there."""
    flat = plain_numbers(stringify_nested(df))
    with layout(flat, by_ticker) as writer:
        writer.option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by_ticker: bool = False) -> None:
    """Parquet; nested columns stay nested."""
    with layout(df, by_ticker) as writer:
        writer.parquet(path)


def write_table(df: DataFrame, name: str) -> None:
    """A catalog table that replaces the old one."""
    df.write.mode("overwrite").saveAsTable(name)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """The registry as JSON lines in ``pos`` order with ``id`` as text. ``pos`` is kept, since a
    dataset of several files has no order of its own."""
    rows = mapping.select("pos", F.col("id").cast("string").alias("id"), "name", "ticker")
    rows.orderBy("pos").write.mode("overwrite").json(path)
