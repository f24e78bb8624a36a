"""Price points laid out by time.

``points`` has a folder per period and bucket of tickers; ``counts`` says how many points, and how many
valid ones, each ticker has in each period. Readers that want the latest points (``sources.periods``) look
at the counts first and then open the folders they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.states import period_of

#: Folders per period; a ticker's points of a period stand in one of them.
BUCKETS = 16


def write_price_periods(
    prices: DataFrame, path: str, unit: str = "month", buckets: int = BUCKETS, append: bool = False
) -> None:
    """Write ``prices`` below ``path`` by UTC period and bucket, and count them.

    ``append`` adds to what is there; otherwise the points replace it. Counts are taken from the written
    files, for the periods that ``prices`` has points in, so a repeated count changes nothing. A
    rebalance gathers a folder's rows and splits large folders over several files. Points without a
    time form a folder of their own.
    """
    spark = prices.sparkSession
    laid = prices.withColumns(
        {"period": period_of(F.col("ts"), unit), "bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")}
    )
    writer = laid.hint("rebalance", "period", "bucket").write.mode("append" if append else "overwrite")
    writer.partitionBy("period", "bucket").parquet(f"{path}/points")
    written = spark.read.schema(laid.schema).parquet(f"{path}/points")
    if append:
        touched = [r[0] for r in laid.select("period").distinct().collect()]  # as many as folders
        dated = F.col("period").isin([p for p in touched if p is not None])
        written = written.where(dated | F.col("period").isNull() if None in touched else dated)
    valid = F.col("value").isNotNull() & ~F.isnan("value")
    counts = written.groupBy("period", "bucket", "ticker").agg(
        F.count("*").alias("points"), F.count_if(valid).alias("valid"), F.max("ts").alias("last_ts")
    )
    counts.write.mode("overwrite").partitionBy("period").option(
        "partitionOverwriteMode", "dynamic" if append else "static"
    ).parquet(f"{path}/counts")
