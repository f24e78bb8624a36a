"""The latest points of every ticker from prices laid out by time (``sinks.periods``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POSITIONED_PRICE_SCHEMA

#: How a folder names a null.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_COUNTS = "bucket int, ticker string, points long, valid long, last_ts long, period date"


def period_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, period, bucket, points, valid, last_ts)``, without a look at the points."""
    return spark.read.schema(_COUNTS).parquet(f"{path}/counts").select("ticker", "period", "bucket", "points", "valid", "last_ts")


def needed_periods(counts: DataFrame, n: int) -> DataFrame:
    """The periods that hold the last ``n`` valid points of each ticker: from the newest on, and further
    back only for tickers that are still short of ``n``. ``n`` of 0 is all."""
    if n < 0:
        raise ValueError("horizon must be 0 (all points) or positive")
    if n == 0:
        return counts
    newer = (
        "coalesce(sum(valid) OVER (PARTITION BY ticker ORDER BY period DESC NULLS LAST "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS newer"
    )
    return counts.selectExpr("*", newer).where(f"newer < {n}").drop("newer")


def read_recent_prices(
    spark: SparkSession, path: str, n: int, tickers: DataFrame | None = None
) -> DataFrame:
    """Points among which are the last ``n`` valid ones of every ticker (or of ``tickers``).

    Only folders that hold a needed period of some ticker are opened; their list, no longer than that of
    the folders, is what the driver sees. ``series.tail`` or ``price_metrics`` with the same ``n`` gives
    the same result from these points as from all.
    """
    counts = period_counts(spark, path)
    if tickers is not None:
        counts = counts.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    needed = needed_periods(counts, n)
    folders = [
        f"{path}/points/period={r.period or _NO_VALUE}/bucket={r.bucket}" for r in needed.select("period", "bucket").distinct().collect()
    ]
    if not folders:
        return spark.createDataFrame([], POSITIONED_PRICE_SCHEMA)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in POSITIONED_PRICE_SCHEMA)}, period date, bucket int"
    points = spark.read.schema(schema).option("basePath", f"{path}/points").parquet(*folders)
    same = points["ticker"].eqNullSafe(needed["ticker"]) & points["period"].eqNullSafe(needed["period"])
    return points.join(needed, same, "left_semi").select(*POSITIONED_PRICE_SCHEMA.names)
