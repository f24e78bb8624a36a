"""Prices laid out by time: which folders a tail opens, and that it equals the tail of all points."""

from __future__ import annotations

import random

import pytest

from marketframe.operators import metrics, series
from marketframe.operators.selection import valid_prices
from marketframe.sinks import write_price_periods
from marketframe.sources import needed_periods, period_counts, read_recent_prices

from .conftest import PRICE_DDL

DAY = 86_400_000


def _rows():
    """Three years by day; B stops after the first year, C is short, D has gaps and values that do not count."""
    rng = random.Random(1)
    rows = [(1, "A", d * DAY, rng.uniform(1, 9), 0, "USD", d) for d in range(1000)]
    rows += [(1, "B", d * DAY, rng.uniform(1, 9), 0, "USD", d) for d in range(300)]
    rows += [(1, "C", 990 * DAY, 2.0, 0, "USD", 0)]
    rows += [(1, "D", d * DAY, rng.choice([None, float("nan"), 3.0]), 0, "USD", d) for d in range(0, 1000, 9)]
    rows += [(1, "D", None, 7.0, 0, "USD", d) for d in range(2000, 2030)]
    return rows


def _points(df):
    return sorted((r.ticker, -1 if r.ts is None else r.ts, r.pos, r.value) for r in df.collect())


@pytest.mark.parametrize("n", [1, 63, 500, 0])
def test_tail_equals_the_tail_of_all_points(spark, tmp_path, n):
    table = spark.createDataFrame(_rows(), PRICE_DDL)
    path = str(tmp_path / "p")
    write_price_periods(table, path, "month", buckets=2)
    recent = read_recent_prices(spark, path, n)
    assert _points(series.tail(valid_prices(recent), n)) == _points(series.tail(valid_prices(table), n))
    found = {r.ticker: r.observations for r in metrics.price_metrics(recent, n).collect()}
    assert found == {r.ticker: r.observations for r in metrics.price_metrics(table, n).collect()}


def test_a_short_tail_opens_few_files(spark, tmp_path):
    table = spark.createDataFrame(_rows(), PRICE_DDL).where("ticker IN ('A', 'C')")
    path = str(tmp_path / "p")
    write_price_periods(table, path, "month", buckets=2)
    every = read_recent_prices(spark, path, 0).inputFiles()
    some = read_recent_prices(spark, path, 63).inputFiles()
    points = [f for f in some if "/points/" in f]
    assert len(points) <= 5 and len([f for f in every if "/points/" in f]) >= 33
    asked = spark.createDataFrame([("C",)], "ticker string")
    assert len([f for f in read_recent_prices(spark, path, 63, asked).inputFiles() if "/points/" in f]) == 1
    nobody = spark.createDataFrame([("X",)], "ticker string")
    assert read_recent_prices(spark, path, 63, nobody).count() == 0


def test_further_periods_only_for_tickers_still_short(spark, tmp_path):
    path = str(tmp_path / "p")
    write_price_periods(spark.createDataFrame(_rows(), PRICE_DDL), path, "year")
    needed = {(r.ticker, str(r.period)[:4]) for r in needed_periods(period_counts(spark, path), 63).collect()}
    assert {p for t, p in needed if t == "A"} == {"1972"}
    assert {p for t, p in needed if t == "B"} == {"1970"}
    assert ("D", "None") in needed  # points without a time come last
    with pytest.raises(ValueError):
        needed_periods(period_counts(spark, path), -1)


def test_appended_points_count_once(spark, tmp_path):
    table = spark.createDataFrame(_rows(), PRICE_DDL)
    path = str(tmp_path / "p")
    write_price_periods(table.where(f"ts < {700 * DAY}"), path)
    write_price_periods(table.where(f"ts >= {700 * DAY} or ts is null"), path, append=True)
    counted = {(r.ticker, r.period): (r.points, r.valid) for r in period_counts(spark, path).collect()}
    assert len(counted) == period_counts(spark, path).count()
    assert sum(p for p, _ in counted.values()) == table.count()
    assert sum(v for _, v in counted.values()) == valid_prices(table).count()
    assert _points(series.tail(valid_prices(read_recent_prices(spark, path, 63)), 63)) == _points(series.tail(valid_prices(table), 63))
