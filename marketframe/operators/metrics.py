"""Price metrics per ticker over the last ``horizon`` valid observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialized
from .selection import narrowing, valid_prices
from .series import HOT_ROWS, TAIL_GROUPS, running, short_series, tail, with_drawdown, with_returns

# Trading days in a year, default number of observations.
TRADING_DAYS = 252
DEFAULT_HORIZON = 63
# The reasons for a report without metrics.
UNKNOWN_TICKER = "Ticker not found"
NO_DATASET = "Stock price data not found"
NO_POINTS = "No stock price data available"
NO_VALID_POINTS = "No valid price data found"


def _volatility() -> Column:
    spread = F.stddev_samp("simple_return") * F.sqrt(F.lit(float(TRADING_DAYS)))
    rises_from_zero = F.bool_or((F.col("previous") == 0) & (F.col("value") != 0))
    return F.when(F.coalesce(rises_from_zero, F.lit(False)), None).otherwise(spread)


def _expressions() -> dict[str, Column]:
    return {
        "latest_price": F.max_by("value", "observation"),
        "average_price": F.avg("value"),
        "high": F.max("value"),
        "low": F.min("value"),
        "volatility_annual": _volatility(),
        "max_drawdown_pct": F.max("drawdown") * 100,
        "observations": F.count("*"),
    }


METRICS = (
    "latest_price",
    "average_price",
    "high",
    "low",
    "volatility_annual",
    "max_drawdown_pct",
    "observations",
)


def _fits(horizon: int, hot_rows: int | None) -> bool:
    """Whether a tail of this length is a light load for one task."""
    return hot_rows is None or horizon * TAIL_GROUPS <= hot_rows


def observed(
    prices: DataFrame, horizon: int = DEFAULT_HORIZON, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The points the metrics look at, with previous value, return, running maximum, drawdown."""
    window = tail(valid_prices(prices), horizon, hot_rows)
    series = running(window, bounded=horizon > 0 and _fits(horizon, hot_rows), hot_rows=hot_rows)
    return with_drawdown(with_returns(series))


def price_metrics(
    prices: DataFrame,
    horizon: int = DEFAULT_HORIZON,
    metrics: Sequence[str] = METRICS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per ticker with the chosen metrics. The horizon counts observations, not days.

    Last tail window, ordered window and aggregation share one exchange on ``ticker``; before it the
    tails of groups of map tasks take another, which carries at most ``horizon`` points per ticker and
    task. Windows that no chosen metric reads are pruned from the plan.
    """
    chosen = _expressions()
    return (
        observed(prices, horizon, hot_rows)
        .groupBy("ticker")
        .agg(*[chosen[m].alias(m) for m in metrics])
    )


def _counted_metrics(prices: DataFrame, horizon: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Metrics of every ticker with points; ``observations`` is 0 where none of them is valid. Short
    tails come from one pass over the points."""
    chosen = _expressions()
    if not horizon or not _fits(horizon, hot_rows):
        found = price_metrics(prices, horizon, hot_rows=hot_rows)
        counted = prices.select("ticker").distinct().join(found, "ticker", "left")
        return counted.withColumn("observations", F.coalesce("observations", F.lit(0).cast("long")))
    blank = prices.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    series = with_drawdown(with_returns(short_series(blank, horizon)))
    chosen["observations"] = F.count("value")
    return series.groupBy("ticker").agg(*[chosen[m].alias(m) for m in METRICS])


def metrics_report(
    requested: DataFrame,
    companies: DataFrame,
    prices: DataFrame,
    datasets: DataFrame | None = None,
    horizon: int = DEFAULT_HORIZON,
) -> DataFrame:
    """Metrics for the requested tickers, or the reason there are none.

    ``datasets`` lists the tickers whose price dataset exists, for telling a missing dataset from
    an empty one; without it a ticker without points counts as empty. Companies, then datasets and prices,
    are narrowed to the tickers that are asked for and known: by a predicate that prunes folders where
    those are few, else by a join (``selection.narrowing``). Prices are read once.
    """
    wanted = requested.select(F.upper("ticker").alias("ticker")).distinct()
    known = materialized(narrowing(wanted)(companies).select("ticker").distinct(), "report-known")
    asked = narrowing(known)
    report = wanted.join(known.withColumn("known", F.lit(True)), "ticker", "left")
    if datasets is not None:
        landed = asked(datasets).select("ticker").distinct().withColumn("landed", F.lit(True))
        report = report.join(landed, "ticker", "left")
        missing = F.col("landed").isNull()
    else:
        missing = F.lit(False)
    report = report.join(_counted_metrics(asked(prices), horizon), "ticker", "left")
    error = (
        F.when(F.col("known").isNull(), UNKNOWN_TICKER)
        .when(missing, NO_DATASET)
        .when(F.col("observations").isNull(), NO_POINTS)
        .when(F.col("observations") == 0, NO_VALID_POINTS)
    )
    report = report.withColumn("error", error)
    good = F.col("error").isNull()
    return report.select(
        "ticker",
        *[F.when(good, F.col(m)).alias(m) for m in METRICS],
        F.when(good, F.current_timestamp()).alias("generated_at"),
        "error",
    )


def analytics_gate(
    requested: DataFrame, companies: DataFrame, prices: DataFrame, horizon: int = DEFAULT_HORIZON
) -> DataFrame:
    """Requested tickers with whether a company document and metrics exist for them. Prices are read for
    tickers that pass the gate only."""
    wanted = requested.select(F.upper("ticker").alias("ticker")).distinct()
    known = materialized(narrowing(wanted)(companies).select("ticker").distinct(), "gate-known")
    computed = price_metrics(narrowing(known)(prices), horizon, ["observations"])
    joined = wanted.join(known.withColumn("known", F.lit(True)), "ticker", "left").join(computed, "ticker", "left")
    return joined.select(
        "ticker",
        F.col("known").isNotNull().alias("company_found"),
        F.col("observations").isNotNull().alias("metrics_found"),
        "observations",
    )
