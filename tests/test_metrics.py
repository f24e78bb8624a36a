from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketframe.operators import metrics, series, timeseries
from marketframe.operators.selection import valid_prices
from marketframe.operators.shaping import unnest_prices

from .conftest import PRICE_DDL


def by_ticker(df):
    return {r.ticker: r for r in df.collect()}


def brute(values: list[float]) -> dict:
    """The metrics of one ordered list, in plain Python."""
    returns, bad = [], False
    for a, b in zip(values, values[1:]):
        if a != 0:
            returns.append(b / a - 1)
        elif b != 0:
            bad = True
    falls, top = [], -math.inf
    for v in values:
        top = max(top, v)
        if top != 0:
            falls.append((top - v) / top)
    return {
        "latest_price": values[-1],
        "average_price": statistics.fmean(values),
        "high": max(values),
        "low": min(values),
        "volatility_annual": None
        if bad or len(returns) < 2
        else statistics.stdev(returns) * math.sqrt(252),
        "max_drawdown_pct": max(falls) * 100 if falls else None,
        "observations": len(values),
    }


def same(row, expected: dict) -> None:
    for name, value in expected.items():
        assert row[name] == (value if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), name


def test_sample_goldens(sample_companies):
    found = by_ticker(metrics.price_metrics(unnest_prices(sample_companies), 63))
    for t, values in {"NOVA": [80, 84, 63, 70, 77], "QRTZ": [12, 15, 9]}.items():
        same(found[t], brute(values))


@pytest.mark.parametrize("hot_rows", [2, 10**6])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_edges(spark, prices, hot_rows, ansi):
    table = prices({"ONE": [5.0], "TWO": [5.0, 6.0], "ZERO": [1.0, 0.0, 2.0], "NIL": [0.0] * 3})
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = by_ticker(metrics.price_metrics(table, 0, hot_rows=hot_rows))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    pick = {t: tuple(r[m] for m in ("volatility_annual", "max_drawdown_pct", "observations")) for t, r in found.items()}
    assert pick == {"ONE": (None, 0.0, 1), "TWO": (None, 0.0, 2), "ZERO": (None, 100.0, 3), "NIL": (None, None, 3)}


def test_invalid_values_go_before_the_tail(prices):
    table = prices({"A": [1.0, None, float("nan"), 2.0, 3.0]})
    row = by_ticker(metrics.price_metrics(table, 2))["A"]
    assert (row.low, row.high, row.observations) == (2.0, 3.0, 2)


def test_horizon(prices):
    table = prices({"A": [9.0, 1.0, 2.0]})
    assert by_ticker(metrics.price_metrics(table, 0))["A"].observations == 3
    assert by_ticker(metrics.price_metrics(table, 2))["A"].high == 2.0
    with pytest.raises(ValueError):
        metrics.price_metrics(table, -1)


def random_series(seed: int):
    rng = random.Random(seed)
    rows, expected = [], {}
    for t, n in (("HOT", 400), ("WARM", 60), ("COLD", 7), ("NULL", 50)):
        points = []
        for i in range(n):
            # Bursts in time, ties that only the position breaks, some points without a time.
            ts = None if t == "NULL" else rng.choice([rng.randrange(10**6), rng.randrange(200)])
            points.append((ts, i, round(rng.uniform(-5, 50), 2) if i % 9 else 0.0))
        rows += [(1, t, ts, v, 0, "USD", i) for ts, i, v in points]
        points.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        expected[t] = [p[2] for p in points]
    rng.shuffle(rows)
    return rows, expected


@pytest.mark.parametrize("horizon", [0, 5, 63])
@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_metrics_match_brute_force(spark, monkeypatch, horizon, hot_rows):
    for module in (series, metrics):  # 5 is a short tail, 63 a long one when tickers are cut
        monkeypatch.setattr(module, "TAIL_GROUPS", 2)
    rows, expected = random_series(horizon + hot_rows)
    table = spark.createDataFrame(rows, PRICE_DDL).repartition(5)
    found = by_ticker(metrics.price_metrics(table, horizon, hot_rows=hot_rows))
    for t, values in expected.items():
        same(found[t], brute(values[-horizon:] if horizon else values))


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_series_match_brute_force(spark, hot_rows):
    rows, expected = random_series(3)
    table = spark.createDataFrame(rows, PRICE_DDL)
    found = series.running(table, hot_rows=hot_rows).orderBy("ticker", "observation").collect()
    for t, values in expected.items():
        mine = [r for r in found if r.ticker == t]
        assert [r.value for r in mine] == values
        assert [r.observation for r in mine] == list(range(1, len(values) + 1))
        assert [r.previous for r in mine] == [None, *values[:-1]]
        assert [r.running_max for r in mine] == [max(values[: i + 1]) for i in range(len(values))]


@pytest.mark.parametrize("size", [1, 4, 25])
@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_rolling_matches_brute_force(spark, size, hot_rows):
    rows, expected = random_series(4)
    table = spark.createDataFrame(rows, PRICE_DDL)
    found = series.rolling(table, size, hot_rows).collect()
    assert len(found) == len(rows)
    for t, values in expected.items():
        mine = sorted(
            (r for r in found if r.ticker == t), key=lambda r: (r.ts is not None, r.ts or 0, r.pos)
        )
        for i, r in enumerate(mine):
            window = values[max(0, i - size + 1) : i + 1]
            assert r.rolling_min == min(window) and r.rolling_max == max(window)
            assert r.rolling_mean == pytest.approx(statistics.fmean(window))
            if len(window) > 1:
                assert r.rolling_std == pytest.approx(statistics.stdev(window), abs=1e-9)
            else:
                assert r.rolling_std is None


@pytest.mark.parametrize("n", [1, 30, 300])
def test_tail_by_segments_matches_plain_tail(spark, monkeypatch, n):
    rows, expected = random_series(5)
    table = spark.createDataFrame(rows, PRICE_DDL)
    monkeypatch.setattr(series, "TAIL_GROUPS", 11)
    found = series.tail(table, n, hot_rows=10).groupBy("ticker").agg(F.sum("value"), F.count("*"))
    assert {r[0]: (pytest.approx(r[1]), r[2]) for r in found.collect()} == {
        t: (sum(v[-n:]), len(v[-n:])) for t, v in expected.items()
    }


@pytest.mark.parametrize(
    "ts",
    [
        "id * 1000",  # even in time
        "if(id = 0, 0, 10000000000 + id)",  # one outlier, the rest crowded together
        "cast(null as bigint)",  # no times at all
        "7",  # one single time
        "if(id < 3900, 7, id)",  # one crowded time with neighbours
    ],
)
def test_hot_ticker_is_split(spark, ts):
    table = spark.range(4000).selectExpr(
        "1L as company_id", "if(id % 3 = 0, 'HOT', concat('T', id % 500)) as ticker", f"{ts} as ts",
        "cast(id as double) as value", "0L as interval", "'USD' as valueUnit", "id as pos",
    )
    hot = series.hot_tickers(table, 100)
    assert [tuple(r) for r in hot.collect()] == [("HOT", 1334)]
    cold, pieces = series.split_by_heat(table, 100)
    assert cold.count() + pieces.count() == 4000 and cold.where("ticker = 'HOT'").isEmpty()
    sizes = pieces.groupBy("ticker", "piece").count()
    assert sizes.agg(F.max("count")).head()[0] <= 100 and sizes.count() >= 13
    found = series.running(table.where("ticker = 'HOT'"), hot_rows=100)
    assert found.where("observation <> value / 3 + 1 or running_max <> value").count() == 0
    assert found.where("previous <> value - 3").count() == 0


def test_crowd_far_from_its_first_position_is_split(spark):
    table = spark.range(4000).selectExpr(
        "1L as company_id", "'HOT' as ticker", "7L as ts", "cast(id as double) as value",
        "0L as interval", "'USD' as valueUnit", "if(id = 0, 0L, 10000000000 + id) as pos",
    )
    pieces = series.split_by_heat(table, 100)[1]
    assert pieces.groupBy("piece").count().agg(F.max("count")).head()[0] <= 100
    assert series.running(table, hot_rows=100).where("observation <> value + 1").isEmpty()


def test_null_ticker_is_a_ticker(spark):
    table = spark.range(300).selectExpr(
        "1L as company_id", "if(id < 280, cast(null as string), 'A') as ticker", "id as ts",
        "cast(id as double) as value", "0L as interval", "'USD' as valueUnit", "id as pos",
    )
    found = series.running(table, hot_rows=50)
    assert found.where("ticker is null and observation = value + 1").count() == 280
    assert series.tail(table, 60, hot_rows=50).count() == 80


def test_cold_and_hot_plans_are_bounded(spark):
    table = spark.range(4000).selectExpr(
        "1L as company_id", "if(id % 3 = 0, 'HOT', concat('T', id % 500)) as ticker", "id as ts",
        "cast(id as double) as value", "0L as interval", "'USD' as valueUnit", "id as pos",
    )
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert planned(series.running(table)).count("Exchange") == 1
    hot = planned(series.running(table, hot_rows=100))
    assert hot.count("Exchange hashpartitioning") <= 6 and hot.count("FileScan") <= 3


def test_tails_of_many_tasks_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(series, "TAIL_GROUPS", 4)
    table = spark.range(0, 4000, 1, 100).selectExpr(
        "1L as company_id", "'HOT' as ticker", "id as ts", "cast(id as double) as value",
        "0L as interval", "'USD' as valueUnit", "id as pos",
    )
    sent = []
    plain = series._last

    def watched(rows, n, *keys):
        sent.append(rows.count())
        return plain(rows, n, *keys)

    monkeypatch.setattr(series, "_last", watched)
    found = series.tail(table, 3)
    assert sorted(r.ts for r in found.collect()) == [3997, 3998, 3999]
    assert sent == [4000, 4 * 3]  # groups x n rows reach the last exchange, not tasks x n


def test_flagship_plan(prices):
    plan = metrics.price_metrics(prices({"A": [1.0]}), 63)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # tails per group of tasks, then per ticker
    assert plan.count("WindowGroupLimit") == 4
    assert "Python" not in plan and "SortAggregate" not in plan


def test_unused_windows_are_pruned(prices):
    plan = metrics.price_metrics(prices({"A": [1.0]}), 63, ["high"])._jdf.queryExecution().executedPlan().toString()
    assert "lag(" not in plan


def test_report_errors(spark, prices):
    table = prices({"GOOD": [1.0, 2.0], "BAD": [None, None], "STRAY": [1.0]})
    tickers = lambda *names: spark.createDataFrame([(n,) for n in names], "ticker string")
    report = metrics.metrics_report(
        tickers("good", "BAD", "EMPTY", "LOST", "STRAY"),
        tickers("GOOD", "BAD", "EMPTY", "LOST"),
        table,
        datasets=tickers("GOOD", "BAD", "EMPTY"),
    )
    found = by_ticker(report)
    assert {t: r.error for t, r in found.items()} == {
        "GOOD": None,
        "BAD": "No valid price data found",
        "EMPTY": "No stock price data available",
        "LOST": "Stock price data not found",
        "STRAY": "Ticker not found",
    }
    assert found["GOOD"].observations == 2 and found["GOOD"].generated_at is not None
    assert found["BAD"].generated_at is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_ohlc_ignores_the_session_zone(spark, zone):
    rows = [
        (1, "A", 1704067200000 + i * 3_600_000, float(i), 0, "USD", i) for i in range(24 * 8)
    ]
    table = spark.createDataFrame(rows, PRICE_DDL)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = timeseries.ohlc(table, "day").orderBy("bucket").collect()
        weeks = timeseries.ohlc(table, "week").orderBy("bucket").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(days) == 8 and str(days[0].bucket) == "2024-01-01"
    assert (days[1].open, days[1].high, days[1].low, days[1].close) == (24.0, 47.0, 24.0, 47.0)
    assert [str(w.bucket) for w in weeks] == ["2024-01-01", "2024-01-08"]
    assert [w.observations for w in weeks] == [168, 24]
    with pytest.raises(ValueError):
        timeseries.ohlc(table, "year")


def test_valid_prices(prices):
    assert valid_prices(prices({"A": [1.0, None, float("nan"), 0.0]})).count() == 2


def test_roll_ups_equal_the_single_units_in_one_scan(spark, tmp_path):
    rows, _ = random_series(9)
    spark.createDataFrame([r[:2] + ((r[2] or 0) * 86_400,) + r[3:] for r in rows], PRICE_DDL).write.parquet(str(tmp_path / "p"))
    table = spark.read.schema(PRICE_DDL).parquet(str(tmp_path / "p"))
    found = timeseries.rolled_up(timeseries.day_states(table))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for unit in timeseries.UNITS:
        single = {(r.ticker, r.bucket): r for r in timeseries.ohlc(table, unit).collect()}
        rows = found.where(F.col("unit") == unit).collect()
        assert len(rows) == len(single)
        for r in rows:
            other = single[r.ticker, r.bucket]
            assert (r.open, r.high, r.low, r.close, r.observations) == (other.open, other.high, other.low, other.close, other.observations)
            assert r["mean"] == pytest.approx(other["mean"])
    with pytest.raises(ValueError):
        timeseries.rolled_up(timeseries.day_states(table), ["year"])
