"""Price metrics, series and calendar buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe import sinks, sources
from marketframe.operators import metrics, selection, series, states, timeseries
from marketframe.workspace import fresh_path, materialized

from .registration import query, rounded, sql_rounded
from .tables import EVENT_PRICES, ORDER_PRICES, epoch_ms, event_prices, order_prices, part_registry, table, ticker

_ROUNDED = metrics.METRICS[:-1]


def _tail_sql(horizon: int, source: str = EVENT_PRICES) -> str:
    keep = f"WHERE from_end <= {horizon}" if horizon else ""
    return f"""
WITH {source},
tail AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, pos DESC) AS from_end
    FROM prices) {keep}
),
series AS (
  SELECT *, lag(value) OVER w AS previous,
         max(value) OVER (PARTITION BY ticker ORDER BY ts, pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max,
         row_number() OVER w AS observation
  FROM tail WINDOW w AS (PARTITION BY ticker ORDER BY ts, pos)
)"""


_METRIC_SQL = {
    "latest_price": "arg_max(value, observation)",
    "average_price": "avg(value)",
    "high": "max(value)",
    "low": "min(value)",
    "volatility_annual": "CASE WHEN bool_or(previous = 0 AND value <> 0) THEN NULL "
    "ELSE stddev_samp(CASE WHEN previous <> 0 THEN value / previous - 1 END) * sqrt(252) END",
    "max_drawdown_pct": "max(CASE WHEN running_max <> 0 THEN (running_max - value) / running_max END) * 100",
    "observations": "count(*)",
}


def _metrics_sql(horizon: int, names=metrics.METRICS, source: str = EVENT_PRICES, digits: int = 6) -> str:
    columns = ", ".join(
        f"{_METRIC_SQL[m] if m == 'observations' else sql_rounded(_METRIC_SQL[m], digits)} AS {m}"
        for m in names
    )
    return f"{_tail_sql(horizon, source)} SELECT ticker, {columns} FROM series GROUP BY ticker"


def _metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[rounded(c, digits).alias(c) if c in _ROUNDED else F.col(c) for c in df.columns]
    )


def _register_metrics() -> None:
    for name, horizon in (("63", 63), ("90", 90), ("all", 0)):

        @query(f"price_metrics_{name}", _metrics_sql(horizon))
        def _(spark: SparkSession, sf_dir: str, horizon: int = horizon) -> DataFrame:
            return _metrics(metrics.price_metrics(event_prices(spark, sf_dir), horizon))

    for name, metric in (
        ("latest", "latest_price"),
        ("average", "average_price"),
        ("high", "high"),
        ("low", "low"),
        ("volatility", "volatility_annual"),
        ("max_drawdown", "max_drawdown_pct"),
        ("observations", "observations"),
    ):

        @query(f"agg_{name}", _metrics_sql(63, [metric]))
        def _(spark: SparkSession, sf_dir: str, metric: str = metric) -> DataFrame:
            return _metrics(metrics.price_metrics(event_prices(spark, sf_dir), 63, [metric]))


_register_metrics()


@query("price_metrics_orders", _metrics_sql(0, source=ORDER_PRICES, digits=4))
def _(spark, sf_dir):
    return _metrics(metrics.price_metrics(order_prices(spark, sf_dir), 0), 4)


@query("price_metrics_states", _metrics_sql(0))
def _(spark, sf_dir):
    """Whole history from one state per ticker and month."""
    prices = event_prices(spark, sf_dir)
    return _metrics(states.metrics_of(states.metric_states(prices, "month"), prices))


@query("price_metrics_extended", _metrics_sql(0))
def _(spark, sf_dir):
    """The same from the states of all but the last quarter of the events, which come as a later batch
    and are the only points read for it."""
    prices = event_prices(spark, sf_dir)
    cut = prices.agg(F.expr("max(ts) - (max(ts) - min(ts)) div 4")).scalar()
    known = materialized(states.metric_states(prices.where(F.col("ts") < cut), "week"), "metric-states")
    later = states.extended(known, prices.where(F.col("ts") >= cut), "week")
    return _metrics(states.metrics_of(later, prices))


@query("win_tail_n", f"{_tail_sql(30)} SELECT ticker, ts, value, pos FROM tail")
def _(spark, sf_dir):
    return series.tail(event_prices(spark, sf_dir), 30).select("ticker", "ts", "value", "pos")


@query("win_tail_recent", f"{_tail_sql(30)} SELECT ticker, ts, value, pos FROM tail")
def _(spark, sf_dir):
    """The same tail from prices laid out by week, of which only the folders it needs are opened."""
    path = fresh_path(spark, "price-periods")
    sinks.write_price_periods(event_prices(spark, sf_dir), path, "week", buckets=4)
    recent = sources.read_recent_prices(spark, path, 30)
    return series.tail(recent, 30).select("ticker", "ts", "value", "pos")


@query(
    "win_returns",
    f"{_tail_sql(0)} SELECT ticker, pos, "
    f"{sql_rounded('CASE WHEN previous <> 0 THEN value / previous - 1 END')} AS simple_return FROM series",
)
def _(spark, sf_dir):
    found = series.with_returns(series.running(event_prices(spark, sf_dir)))
    return found.select("ticker", "pos", rounded("simple_return").alias("simple_return"))


@query("win_running_max", f"{_tail_sql(0)} SELECT ticker, pos, running_max FROM series")
def _(spark, sf_dir):
    return series.running(event_prices(spark, sf_dir)).select("ticker", "pos", "running_max")


@query(
    "win_drawdown",
    f"{_tail_sql(0)} SELECT ticker, pos, "
    f"{sql_rounded('(running_max - value) / running_max')} AS drawdown FROM series",
)
def _(spark, sf_dir):
    found = series.with_drawdown(series.running(event_prices(spark, sf_dir)))
    return found.select("ticker", "pos", rounded("drawdown").alias("drawdown"))


@query(
    "win_rolling_stats",
    f"""WITH {EVENT_PRICES}
SELECT ticker, pos, {sql_rounded('avg(value) OVER w')} AS rolling_mean,
       {sql_rounded('stddev_samp(value) OVER w')} AS rolling_std,
       min(value) OVER w AS rolling_min, max(value) OVER w AS rolling_max
FROM prices
WINDOW w AS (PARTITION BY ticker ORDER BY ts, pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf_dir):
    return series.rolling(event_prices(spark, sf_dir), 20).select(
        "ticker",
        "pos",
        rounded("rolling_mean").alias("rolling_mean"),
        rounded("rolling_std").alias("rolling_std"),
        "rolling_min",
        "rolling_max",
    )


def type_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a few long series, one per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), epoch_ms("ts").alias("ts"), "value", F.col("event_id").alias("pos")
    )


@query(
    "win_rolling_long",
    f"""SELECT event_type AS ticker, event_id AS pos, {sql_rounded('avg(value) OVER w')} AS rolling_mean,
       {sql_rounded('stddev_samp(value) OVER w')} AS rolling_std,
       min(value) OVER w AS rolling_min, max(value) OVER w AS rolling_max
FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf_dir):
    return series.rolling(type_prices(spark, sf_dir), 5_000).select(
        "ticker",
        "pos",
        rounded("rolling_mean").alias("rolling_mean"),
        rounded("rolling_std").alias("rolling_std"),
        "rolling_min",
        "rolling_max",
    )


@query(
    "srt_chronological",
    f"{_tail_sql(0)} SELECT ticker, pos, ts, value, observation FROM series",
)
def _(spark, sf_dir):
    return series.chronological(event_prices(spark, sf_dir)).select(
        "ticker", "pos", "ts", "value", "observation"
    )


def _ohlc_sql(unit: str, source: str, digits: int) -> str:
    return f"""WITH {source}
SELECT ticker, date_trunc('{unit}', epoch_ms(ts))::DATE AS bucket,
       arg_min(value, (ts, pos)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, pos)) AS close, {sql_rounded('avg(value)', digits)} AS mean,
       count(*) AS observations
FROM prices GROUP BY ticker, bucket"""


def _register_buckets() -> None:
    for unit, prices, source, digits in (
        ("day", event_prices, EVENT_PRICES, 6),
        ("week", event_prices, EVENT_PRICES, 6),
        ("month", order_prices, ORDER_PRICES, 4),
    ):

        @query(f"ts_ohlc_{unit}", _ohlc_sql(unit, source, digits))
        def _(spark, sf_dir, unit=unit, prices=prices, digits=digits):
            found = timeseries.ohlc(prices(spark, sf_dir), unit)
            return found.withColumn("mean", rounded("mean", digits))


_register_buckets()


@query(
    "ts_ohlc_rollup",
    f"WITH {EVENT_PRICES} "
    + " UNION ALL ".join(
        f"""SELECT ticker, '{unit}' AS unit, date_trunc('{unit}', epoch_ms(ts))::DATE AS bucket,
       arg_min(value, (ts, pos)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, pos)) AS close, {sql_rounded('avg(value)')} AS mean, count(*) AS observations
FROM prices GROUP BY ticker, bucket"""
        for unit in ("day", "week", "month")
    ),
)
def _(spark, sf_dir):
    """Days, weeks and months from one state per day, in one pass over the prices."""
    found = timeseries.rolled_up(timeseries.day_states(event_prices(spark, sf_dir)))
    return found.withColumn("mean", rounded("mean"))


@query(
    "flt_ticker",
    "SELECT 'T' || user_id AS ticker, event_id AS pos, value FROM events WHERE user_id = 7",
)
def _(spark, sf_dir):
    return selection.for_ticker(event_prices(spark, sf_dir), "t7").select("ticker", "pos", "value")


@query(
    "flt_valid_price",
    "SELECT event_id AS pos, value FROM events WHERE event_type IN ('click', 'purchase')",
)
def _(spark, sf_dir):
    """Values as JSON: text for views, null for errors, text "NaN" for sign-ups, else numbers."""
    events = table(spark, sf_dir, "events")
    value = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('"'), "value", F.lit('"')))
        .when(F.col("event_type") == "error", F.lit("null"))
        .when(F.col("event_type") == "signup", F.lit('"NaN"'))
        .otherwise(F.col("value").cast("string"))
    )
    point = F.from_json(F.concat(F.lit('{"value": '), value, F.lit("}")), "value double")
    typed = events.select(F.col("event_id").alias("pos"), point["value"].alias("value"))
    return selection.valid_prices(typed)


def _report_inputs(spark: SparkSession, sf_dir: str):
    """Requested: all parts. Known: customers. Datasets: customers with a finished order. Points:
    urgent orders, whose value is a number only while the order is pending."""
    orders = table(spark, sf_dir, "orders")
    requested = part_registry(spark, sf_dir)
    companies = table(spark, sf_dir, "customer").select(ticker("c_custkey").alias("ticker"))
    datasets = orders.where("o_orderstatus = 'F'").select(ticker("o_custkey").alias("ticker"))
    urgent = order_prices(spark, sf_dir).join(
        orders.where("o_orderpriority = '1-URGENT'").select(
            F.col("o_orderkey").alias("pos"), "o_orderstatus"
        ),
        "pos",
    )
    prices = urgent.withColumn("value", F.when(F.col("o_orderstatus") == "P", F.col("value")))
    return requested, companies, prices.drop("o_orderstatus"), datasets


_REPORT_SQL = """
prices AS (
  SELECT 'T' || o_custkey AS ticker, epoch_us(o_orderdate) // 1000 AS ts, o_totalprice AS value,
         o_orderkey AS pos
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
)"""


@query(
    "metrics_with_errors",
    _tail_sql(63, _REPORT_SQL)
    + ", m AS (SELECT ticker, "
    + ", ".join(
        f"{_METRIC_SQL[m] if m == 'observations' else sql_rounded(_METRIC_SQL[m], 4)} AS {m}"
        for m in metrics.METRICS
    )
    + """ FROM series GROUP BY ticker),
judged AS (
  SELECT 'T' || p_partkey AS ticker,
         CASE WHEN c_custkey IS NULL THEN 'Ticker not found'
              WHEN p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
                THEN 'Stock price data not found'
              WHEN p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
                THEN 'No stock price data available'
              WHEN p_partkey NOT IN (SELECT o_custkey FROM orders
                                     WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
                THEN 'No valid price data found' END AS error
  FROM part LEFT JOIN customer ON p_partkey = c_custkey
)
SELECT j.ticker, """
    + ", ".join(f"CASE WHEN error IS NULL THEN {m} END AS {m}" for m in metrics.METRICS)
    + ", error FROM judged j LEFT JOIN m ON j.ticker = m.ticker",
)
def _(spark, sf_dir):
    report = metrics.metrics_report(*_report_inputs(spark, sf_dir))
    return _metrics(report.drop("generated_at"), 4)


@query(
    "jon_analytics_gate",
    """
SELECT 'T' || p_partkey AS ticker, c_custkey IS NOT NULL AS company_found,
       c_custkey IS NOT NULL AND n IS NOT NULL AS metrics_found,
       CASE WHEN c_custkey IS NOT NULL AND n IS NOT NULL THEN least(n, 63) END AS observations
FROM part LEFT JOIN customer ON p_partkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
           WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1)
  ON p_partkey = o_custkey""",
)
def _(spark, sf_dir):
    requested, companies, prices, _ = _report_inputs(spark, sf_dir)
    return metrics.analytics_gate(requested, companies, prices)
