"""Calendar buckets over price series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import valid_prices

DAY_MS = 86_400_000
UNITS = ("day", "week", "month")


def _day() -> Column:
    return F.date_from_unix_date(F.floor(F.col("ts") / DAY_MS).cast("int"))


def _bucket(day: Column, unit: str) -> Column:
    return day if unit == "day" else F.trunc(day, unit).cast("date")


def ohlc(prices: DataFrame, unit: str) -> DataFrame:
    """Open, high, low, close, mean and count per ticker and UTC day, week (from Monday) or month.

    The bucket is a DATE taken from the epoch, so the session time zone does not matter. Partial
    aggregation on the map side keeps a hot ticker to a few rows per bucket in the exchange.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    day = _day()
    bucket = _bucket(day, unit)
    moment = F.struct("ts", "pos")
    return (
        valid_prices(prices)
        .where(F.col("ts").isNotNull())
        .groupBy("ticker", bucket.alias("bucket"))
        .agg(
            F.min_by("value", moment).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", moment).alias("close"),
            F.avg("value").alias("mean"),
            F.count("*").alias("observations"),
        )
    )


def day_states(prices: DataFrame) -> DataFrame:
    """One state per ticker and UTC day: first and last point ``(ts, pos, value)``, high, low, sum, count.
    States of any days merge by minimum, maximum and sum, so they serve every longer unit."""
    point = F.struct("ts", "pos", "value")
    return (
        valid_prices(prices)
        .where(F.col("ts").isNotNull())
        .groupBy("ticker", _day().alias("day"))
        .agg(
            F.min(point).alias("first"),
            F.max(point).alias("last"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.sum("value").alias("total"),
            F.count("*").alias("observations"),
        )
    )


def rolled_up(days: DataFrame, units: Sequence[str] = UNITS) -> DataFrame:
    """``(ticker, unit, bucket, open, high, low, close, mean, observations)`` of several units from day
    states (of one pass over the prices, or kept from earlier runs). A day's state goes once to the
    bucket of every unit; the points are not looked at again."""
    unknown = set(units) - set(UNITS)
    if unknown or not units:
        raise ValueError(f"units must be among {UNITS}")
    buckets = F.array(*(F.struct(F.lit(u).alias("unit"), _bucket(F.col("day"), u).alias("bucket")) for u in units))
    return (
        days.withColumn("to", F.explode(buckets))
        .groupBy("ticker", "to.unit", "to.bucket")
        .agg(
            F.min("first")["value"].alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max("last")["value"].alias("close"),
            (F.sum("total") / F.sum("observations")).alias("mean"),
            F.sum("observations").alias("observations"),
        )
    )
