"""Price metrics as states that merge: whole history in one pass, later points added without a re-read.

A state sums up the points of one ticker in one period, in the order ``(ts, pos)``: how many, their sum,
first and last value, high and low, count, mean and squared deviations of the returns inside, and the
largest fall. States of neighbouring pieces merge, and the merge is associative:

* across a border stands one more return, from the last value before to the first one after;
* the largest fall is that of a piece, or from the highest value before a piece to the low in it;
* counts, means and squared deviations combine as those of two samples do.

So no task ever holds more than one period of one ticker, and a ticker of any length is a few state rows.
A fall from a positive high to a value below zero has no such state (the share of a later, higher maximum
can be smaller); states mark tickers that had one, whose drawdown is then taken from the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import METRICS, TRADING_DAYS, price_metrics
from .selection import valid_prices
from .series import HOT_ROWS, split_by_heat
from .timeseries import DAY_MS

#: Periods that states may be kept by.
PERIODS = ("day", "week", "month", "quarter", "year")

_ORDER = "ts ASC NULLS FIRST, pos ASC NULLS FIRST"
_STATES = "first_moment ASC NULLS FIRST, last_moment ASC NULLS FIRST"


def period_of(ts: Column, unit: str) -> Column:
    """The first day of the UTC day, week, month, quarter or year of an epoch in milliseconds."""
    if unit not in PERIODS:
        raise ValueError(f"unit must be one of {PERIODS}")
    day = F.date_from_unix_date(F.floor(ts / DAY_MS).cast("int"))
    return day if unit == "day" else F.trunc(day, unit).cast("date")


def metric_states(prices: DataFrame, unit: str = "month", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``(ticker, period, …)``: one state per ticker and period with valid points.

    One exchange on ``(ticker, period)``. Periods with more than ``hot_rows`` points of one ticker are
    cut by ranges first and their pieces merged (``hot_rows=None`` says that there are none, which spares
    the pass that looks for them). Points without a time form the period null, which comes first.
    """
    points = valid_prices(prices).select("ticker", period_of(F.col("ts"), unit).alias("period"), "ts", "pos", "value")
    if hot_rows is None:
        return _piece_states(points, ["ticker", "period"])
    # Heat is found and cut per ticker and period, so the pair plays the ticker's part.
    paired = points.withColumn("ticker", F.struct("ticker", "period")).drop("period")
    cold, pieces = split_by_heat(paired, hot_rows)

    def unpaired(df: DataFrame) -> DataFrame:
        return df.withColumns({"period": F.col("ticker.period"), "ticker": F.col("ticker.ticker")})

    found = _piece_states(unpaired(cold), ["ticker", "period"])
    if pieces is None:
        return found
    cut = merged(_piece_states(unpaired(pieces), ["ticker", "period", "piece"]), ["ticker", "period"])
    return found.unionByName(cut)


def _piece_states(points: DataFrame, keys: list[str]) -> DataFrame:
    """States of groups of points that each fit a task."""
    over = f"PARTITION BY {', '.join(keys)} ORDER BY {_ORDER}"
    series = points.selectExpr(
        "*",
        f"lag(value) OVER ({over}) AS previous",
        f"max(value) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max",
    )
    gain = F.try_divide(F.col("value"), F.col("previous")) - 1
    fall = F.try_divide(F.col("running_max") - F.col("value"), F.col("running_max"))
    moment = F.struct("ts", "pos")
    return series.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.sum("value").alias("total"),
        F.min(moment).alias("first_moment"),
        F.max(moment).alias("last_moment"),
        F.min(F.struct("ts", "pos", "value"))["value"].alias("first_value"),
        F.max(F.struct("ts", "pos", "value"))["value"].alias("last_value"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.count(gain).alias("returns"),
        F.avg(gain).alias("return_mean"),
        (F.var_pop(gain) * F.count(gain)).alias("return_squares"),
        F.coalesce(F.bool_or((F.col("previous") == 0) & (F.col("value") != 0)), F.lit(False)).alias("rises_from_zero"),
        F.max(fall).alias("fall"),
        (F.min("value") < 0).alias("below_zero"),
    )


def merged(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The states of each group of ``keys`` (``["ticker"]`` by default) as one, in the order of their
    points. The pieces of a group must not overlap; merging by period first and then by ticker gives the
    same as merging at once."""
    keys = keys or ["ticker"]
    group = f"PARTITION BY {', '.join(keys)}"
    over = f"{group} ORDER BY {_STATES}"
    border = "CASE WHEN _last <> 0 THEN first_value / _last - 1 END"
    known = states.selectExpr(
        "*",
        f"lag(last_value) OVER ({over}) AS _last",
        f"max(high) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _high",
    ).selectExpr("*", f"{border} AS _gain")
    weighed = known.selectExpr(
        "*",
        "returns * coalesce(return_mean, 0) + coalesce(_gain, 0) AS _sum",
        "returns + if(_gain IS NULL, 0, 1) AS _n",
    ).selectExpr("*", f"try_divide(sum(_sum) OVER ({group}), sum(_n) OVER ({group})) AS _mean")
    squares = (
        "coalesce(return_squares, 0) + returns * coalesce(power(return_mean - _mean, 2), 0) + coalesce(power(_gain - _mean, 2), 0)"
    )
    steep = "CASE WHEN _high > 0 THEN (_high - low) / _high END"
    return weighed.groupBy(*keys).agg(
        F.sum("observations").alias("observations"),
        F.sum("total").alias("total"),
        F.min("first_moment").alias("first_moment"),
        F.max("last_moment").alias("last_moment"),
        F.min(F.struct("first_moment", "last_moment", "first_value"))["first_value"].alias("first_value"),
        F.max(F.struct("first_moment", "last_moment", "last_value"))["last_value"].alias("last_value"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("_n").cast("long").alias("returns"),
        F.max("_mean").alias("return_mean"),
        F.sum(F.expr(squares)).alias("return_squares"),
        F.bool_or(F.expr("rises_from_zero OR coalesce(_last = 0 AND first_value <> 0, false)")).alias("rises_from_zero"),
        F.max(F.expr(f"greatest(fall, {steep})")).alias("fall"),
        F.bool_or("below_zero").alias("below_zero"),
    )


def metrics_of(states: DataFrame, prices: DataFrame | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The price metrics of every ticker, from states of any number of pieces.

    Tickers with a value below zero get their drawdown from ``prices`` (only those tickers are read), or
    null without it.
    """
    whole = merged(states)
    spread = F.when(
        F.col("returns") >= 2, F.sqrt(F.col("return_squares") / (F.col("returns") - 1)) * F.sqrt(F.lit(float(TRADING_DAYS)))
    )
    columns = {
        "latest_price": F.col("last_value"),
        "average_price": F.col("total") / F.col("observations"),
        "high": F.col("high"),
        "low": F.col("low"),
        "volatility_annual": F.when(~F.col("rises_from_zero"), spread),
        "max_drawdown_pct": F.when(~F.col("below_zero"), F.col("fall") * 100),
        "observations": F.col("observations"),
    }
    found = whole.select("ticker", "below_zero", *(columns[m].alias(m) for m in METRICS))
    if prices is None:
        return found.drop("below_zero")
    odd = found.where("below_zero").select("ticker")
    falls = price_metrics(prices.join(odd, "ticker", "left_semi"), 0, ["max_drawdown_pct"], hot_rows)
    falls = falls.withColumnsRenamed({"ticker": "_ticker", "max_drawdown_pct": "_fall"})
    joined = found.join(falls, found["ticker"].eqNullSafe(falls["_ticker"]), "left")
    return joined.withColumn("max_drawdown_pct", F.coalesce("max_drawdown_pct", "_fall")).select("ticker", *METRICS)


def extended(states: DataFrame, later: DataFrame, unit: str = "month", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``states`` with the points of ``later`` added, without a look at earlier points.

    Every point of a ticker must come after those its states hold; one that does not stops the job
    (``late_periods`` tells which periods to make anew from their points).
    """
    fresh = metric_states(later, unit, hot_rows)
    pieces = states.unionByName(fresh)
    over = f"PARTITION BY ticker ORDER BY {_STATES}"
    checked = pieces.selectExpr(
        "*", f"max(last_moment) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before"
    )
    message = F.concat(F.lit("points of "), F.coalesce("ticker", F.lit("null")), F.lit(" do not come after those summed up"))
    ordered = F.when(F.col("_before") >= F.col("first_moment"), F.raise_error(message)).otherwise(F.lit(True))
    return merged(checked.where(ordered).drop("_before"), ["ticker", "period"])


def late_periods(states: DataFrame, later: DataFrame, unit: str = "month") -> DataFrame:
    """``(ticker, period)`` of states that points of ``later`` fall into or before: those periods must be
    made anew, from all their points."""
    firsts = valid_prices(later).groupBy("ticker").agg(F.min(F.struct("ts", "pos")).alias("_first"))
    firsts = firsts.withColumnRenamed("ticker", "_ticker")
    late = states.join(firsts, states["ticker"].eqNullSafe(firsts["_ticker"])).where("last_moment >= _first")
    touched = valid_prices(later).select("ticker", period_of(F.col("ts"), unit).alias("period")).distinct()
    own = late.select("ticker", "period")
    both = own["ticker"].eqNullSafe(touched["ticker"]) & own["period"].eqNullSafe(touched["period"])
    return own.join(touched, both, "left_semi")


def replaced(states: DataFrame, anew: DataFrame) -> DataFrame:
    """``states`` with those of the tickers and periods in ``anew`` taken from there."""
    same = states["ticker"].eqNullSafe(anew["ticker"]) & states["period"].eqNullSafe(anew["period"])
    return states.join(anew, same, "left_anti").unionByName(anew)
