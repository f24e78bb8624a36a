"""Metric states against plain Python, and long rolling frames against the sliding ones."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketframe.operators import metrics, series, states

from .conftest import PRICE_DDL
from .test_metrics import brute, by_ticker, random_series, same

DAY = 86_400_000


def _rows(seed, low=0.0):
    """Series over 400 days with bursts, ties in time, zeros, NaN, nulls and points without a time."""
    rng = random.Random(seed)
    rows, expected = [], {}
    for ticker, n in (("HOT", 300), ("WARM", 50), ("ONE", 1), ("ZERO", 6), ("GAP", 12), (None, 20)):
        points = []
        for i in range(n):
            day = rng.choice([rng.randrange(400), 17])
            ts = None if rng.random() < 0.05 else day * DAY + rng.randrange(3)
            value = 0.0 if ticker == "ZERO" or rng.random() < 0.03 and ticker == "HOT" else round(rng.uniform(low, 50), 2)
            points.append((ts, i, value))
        rows += [(1, ticker, ts, v, 0, "USD", i) for ts, i, v in points]
        rows += [(1, ticker, 5 * DAY, v, 0, "USD", 1000 + i) for i, v in enumerate((None, float("nan")))]
        points.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        expected[ticker] = [v for _, _, v in points]
    rng.shuffle(rows)
    return rows, expected


@pytest.mark.parametrize("unit, hot_rows", [("day", 7), ("month", 10**6), ("year", 7), ("year", None)])
def test_states_give_the_metrics(spark, unit, hot_rows):
    rows, expected = _rows(1)
    table = spark.createDataFrame(rows, PRICE_DDL).repartition(5)
    found = by_ticker(states.metrics_of(states.metric_states(table, unit, hot_rows)))
    assert set(found) == set(expected)
    for ticker, values in expected.items():
        same(found[ticker], brute(values))


def test_merging_is_associative(spark):
    rows, expected = _rows(2)
    days = states.metric_states(spark.createDataFrame(rows, PRICE_DDL), "day", None)
    years = states.merged(days.withColumn("period", F.trunc("period", "year").cast("date")), ["ticker", "period"])
    found = by_ticker(states.metrics_of(states.merged(years)))
    for ticker, values in expected.items():
        same(found[ticker], brute(values))


def test_later_points_extend_states(spark):
    rows, expected = _rows(3)
    table = spark.createDataFrame(rows, PRICE_DDL)
    early = table.where(f"ts is null or ts < {100 * DAY}")
    known = states.metric_states(early, "month", None)
    for first, last in ((100, 101), (101, 250), (250, 999)):  # the first cuts through a month
        batch = table.where(f"ts >= {first * DAY} and ts < {last * DAY}")
        known = states.extended(known, batch, "month", None)
    assert known.groupBy("ticker", "period").count().where("count > 1").isEmpty()
    found = by_ticker(states.metrics_of(known))
    for ticker, values in expected.items():
        same(found[ticker], brute(values))


def test_late_points_are_refused_and_their_periods_made_anew(spark):
    rows, expected = _rows(4)
    table = spark.createDataFrame(rows, PRICE_DDL)
    late = table.where(f"ts >= {40 * DAY} and ts < {50 * DAY}")
    known = states.metric_states(table.join(late, ["ticker", "pos"], "left_anti").select(*table.columns), "month", None)
    with pytest.raises(PySparkException, match="do not come after"):
        states.extended(known, late, "month", None).collect()
    stale = states.late_periods(known, late, "month")
    touched = {(r.ticker, r.period) for r in stale.collect()}
    assert touched and len(touched) < known.count()
    period = states.period_of(F.col("ts"), "month")
    new = late.select("ticker", period.alias("period")).distinct().collect()
    wanted = {(r.ticker, r.period) for r in new}
    own = table.where(f"ts >= {31 * DAY} and ts < {59 * DAY}")  # the points of February 1970
    assert {p.isoformat() for _, p in wanted} == {"1970-02-01"}
    found = by_ticker(states.metrics_of(states.replaced(known, states.metric_states(own, "month", None))))
    for ticker, values in expected.items():
        same(found[ticker], brute(values))


def test_values_below_zero_take_their_drawdown_from_the_points(spark):
    rows, expected = random_series(5)
    table = spark.createDataFrame(rows, PRICE_DDL)
    kept = states.metric_states(table, "day")
    found = by_ticker(states.metrics_of(kept, table))
    for ticker, values in expected.items():
        same(found[ticker], brute(values))
    assert by_ticker(states.metrics_of(kept))["HOT"].max_drawdown_pct is None


def test_empty_prices_have_no_states(spark):
    empty = spark.createDataFrame([], PRICE_DDL)
    kept = states.metric_states(empty)
    assert kept.count() == 0 and states.metrics_of(kept, empty).count() == 0
    assert states.extended(kept, empty).count() == 0
    with pytest.raises(ValueError):
        states.metric_states(empty, "hour")


@pytest.mark.parametrize("size, hot_rows", [(1, 40), (2, None), (7, 40), (60, 10**6), (60, 40), (1000, None)])
def test_blocks_equal_sliding_frames(spark, monkeypatch, size, hot_rows):
    rows, _ = random_series(size)
    rows += [(1, "GAPS", i, None if i % 3 else 1.5, 0, "USD", i) for i in range(30)]
    rows += [(1, "SAME", i, 0.1, 0, "USD", i) for i in range(30)]
    table = spark.createDataFrame(rows, PRICE_DDL)
    monkeypatch.setattr(series, "SHORT_FRAME", 10**6)
    plain = {(r.ticker, r.pos): r for r in series.rolling(table, size, None).collect()}
    monkeypatch.setattr(series, "SHORT_FRAME", 0)
    found = series.rolling(table, size, hot_rows).collect()
    assert len(found) == len(rows)
    for r in found:
        other = plain[r.ticker, r.pos]
        assert (r.rolling_min, r.rolling_max) == (other.rolling_min, other.rolling_max)
        for name in ("rolling_mean", "rolling_std"):
            assert (r[name] is None) == (other[name] is None), (name, r)
            assert r[name] is None or r[name] == pytest.approx(other[name], rel=1e-9, abs=1e-9)


def test_one_exchange_for_states_and_long_frames(spark):
    table = spark.createDataFrame([(1, "A", 1, 1.0, 0, "USD", 1)], PRICE_DDL)
    for df in (states.metric_states(table, hot_rows=None), series.rolling(table, 5_000, None)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    assert metrics.METRICS == tuple(c for c in states.metrics_of(states.metric_states(table, hot_rows=None)).columns[1:])
