"""Price series in order, with no task holding a whole hot ticker.

Points are ordered by ``(ts NULLS FIRST, pos)`` within a ticker. Tickers of at most ``hot_rows``
points share one exchange on ``ticker``. Those above it are placed once by ranges of
``(ticker, ts, pos)`` and written to shared storage; each range partition is a piece of the order, so
points that crowd on one time or position are split like any others. Windows then run within
``(ticker, piece)`` and take what came before (count, maximum, last value) from a carry table with one
row per ticker and piece.

Finding the hot tickers is one aggregation that combines on the map side; it runs while the plan is
built, and without hot tickers their branch is not planned at all. No number of tickers or pieces is
bounded in advance, so nothing here is broadcast by hint: Spark decides by size. Where a ticker is cut
has no influence on any result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialized

#: Points of one ticker that a single task may hold before the ticker is cut.
HOT_ROWS = 2_000_000
#: Range partitions are planned this much smaller than ``hot_rows``, since their borders are sampled.
SLACK = 2
#: Groups of map tasks whose tails are cut separately before a ticker's last points meet in one task.
TAIL_GROUPS = 256
#: Longest rolling frame that is recomputed for every point.
SHORT_FRAME = 64

_PIECE = ["ticker", "piece"]


def hot_tickers(prices: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(ticker, n)`` of the tickers with more than ``hot_rows`` points, written once."""
    sizes = prices.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    return materialized(sizes, "hot-tickers")


def _same_ticker(prices: DataFrame, hot: DataFrame):
    return prices["ticker"].eqNullSafe(hot["ticker"])


def split_by_heat(prices: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The points of ordinary tickers, and the placed points of hot ones (None without any)."""
    hot = hot_tickers(prices, hot_rows)
    total = hot.agg(F.sum("n")).head()[0]
    if not total:
        return prices, None
    cold = prices.join(hot, _same_ticker(prices, hot), "left_anti")
    return cold, placed(prices.join(hot, _same_ticker(prices, hot), "left_semi"), total, hot_rows)


def placed(prices: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """``total`` points with ``piece``, their range partition in the order of ``(ticker, ts, pos)``;
    written once, so that every later branch sees the same pieces."""
    parts = math.ceil(total * SLACK / hot_rows)
    ranged = prices.repartitionByRange(parts, "ticker", "ts", "pos")
    return materialized(ranged.withColumn("piece", F.spark_partition_id()), "series-pieces")


def carry(pieces: DataFrame) -> DataFrame:
    """What precedes and follows each piece of a ticker."""
    held = pieces.groupBy(*_PIECE).agg(
        F.expr("count(*) AS n"),
        F.expr("max(value) AS high"),
        F.expr("max_by(value, struct(ts, pos)) AS last"),
    )
    order = "PARTITION BY ticker ORDER BY piece"
    before = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    after = f"{order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    return held.selectExpr(
        *_PIECE,
        f"coalesce(sum(n) OVER ({before}), 0L) AS prior_count",
        f"coalesce(sum(n) OVER ({after}), 0L) AS later_count",
        f"max(high) OVER ({before}) AS prior_high",
        f"lag(last) OVER ({order}) AS prior_value",
    )


def _with_carry(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    known = carry(pieces).withColumnsRenamed({"ticker": "_ticker", "piece": "_piece"})
    same = rows["ticker"].eqNullSafe(known["_ticker"]) & (rows["piece"] == known["_piece"])
    return rows.join(known, same).drop("_ticker", "_piece")


_OLDEST_FIRST = "ORDER BY ts ASC NULLS FIRST, pos ASC NULLS FIRST"
_LATEST_FIRST = "ORDER BY ts DESC NULLS LAST, pos DESC NULLS LAST"
#: The same orders with points without a value before all others.
_BLANKS_FIRST = _OLDEST_FIRST.replace("ORDER BY", "ORDER BY value IS NOT NULL,")
_BLANKS_LAST = _LATEST_FIRST.replace("ORDER BY", "ORDER BY value IS NULL,")


def _running_columns(partition: str, order: str = _OLDEST_FIRST) -> list[str]:
    window = f"PARTITION BY {partition} {order}"
    return [
        f"bigint(row_number() OVER ({window})) AS observation",
        f"lag(value) OVER ({window}) AS previous",
        f"max(value) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max",
    ]


def running(
    prices: DataFrame, bounded: bool = False, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Add ``observation`` (1-based, oldest first), ``previous`` (value before) and ``running_max``.

    ``bounded=True`` states that every ticker is already short because a tail was taken;
    ``hot_rows=None`` that the caller knows no ticker to be large. Either makes the cuts, and the
    pass that finds them, unnecessary.
    """
    if bounded or hot_rows is None:
        return prices.selectExpr("*", *_running_columns("ticker"))
    cold, pieces = split_by_heat(prices, hot_rows)
    found = cold.selectExpr("*", *_running_columns("ticker"))
    if pieces is None:
        return found
    rows = pieces.selectExpr("*", *_running_columns(", ".join(_PIECE)))
    cut = _with_carry(rows, pieces).selectExpr(
        *[f"`{c}`" for c in prices.columns],
        "observation + prior_count AS observation",
        "if(observation = 1, prior_value, previous) AS previous",
        "greatest(running_max, prior_high) AS running_max",
    )
    return found.unionByName(cut)


def _last(rows: DataFrame, n: int, *keys: str, order: str = _LATEST_FIRST) -> DataFrame:
    from_end = f"row_number() OVER (PARTITION BY {', '.join(keys)} {order}) AS _from_end"
    return rows.selectExpr("*", from_end).where(f"_from_end <= {n}").drop("_from_end")


def _grouped_last(prices: DataFrame, n: int, **how: str) -> DataFrame:
    """The last ``n`` points per ticker, by way of those of each group of map tasks."""
    grouped = prices.withColumn("_tasks", F.spark_partition_id() % TAIL_GROUPS)
    return _last(_last(grouped, n, "ticker", "_tasks", **how).drop("_tasks"), n, "ticker", **how)


def short_series(prices: DataFrame, n: int) -> DataFrame:
    """The last ``n`` points with a value per ticker as ``running`` gives them, and, of tickers short of
    ``n``, points without one before them: every ticker with any point has a row. One pass."""
    return _grouped_last(prices, n, order=_BLANKS_LAST).selectExpr("*", *_running_columns("ticker", _BLANKS_FIRST))


def tail(prices: DataFrame, n: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The last ``n`` points per ticker; 0 keeps all, a negative number is refused.

    ``row_number() <= n`` reaches the map side as a group limit, so a task sends at most ``n`` points
    per ticker. Of a hot ticker those still come from every map task; they meet in ``TAIL_GROUPS``
    groups of tasks first, and the last exchange brings at most ``TAIL_GROUPS * n`` points of a ticker
    together. Tails too long for that to fit ``hot_rows`` are taken from the pieces instead.
    """
    if n < 0:
        raise ValueError("horizon must be 0 (all points) or positive")
    if n == 0:
        return prices
    if hot_rows is None:
        return _last(prices, n, "ticker")
    if n * TAIL_GROUPS <= hot_rows:
        return _grouped_last(prices, n)
    cold, pieces = split_by_heat(prices, hot_rows)
    found = _last(cold, n, "ticker")
    if pieces is None:
        return found
    from_end = f"row_number() OVER (PARTITION BY {', '.join(_PIECE)} {_LATEST_FIRST}) AS _from_end"
    rows = _with_carry(pieces.selectExpr("*", from_end), pieces)
    return found.unionByName(rows.where(f"_from_end + later_count <= {n}").select(*prices.columns))


def with_returns(series: DataFrame) -> DataFrame:
    """Add ``simple_return``: value over the value before, minus one; null on the first point and
    where the value before is zero."""
    return series.withColumn(
        "simple_return", F.try_divide(F.col("value"), F.col("previous")) - 1
    )


def with_drawdown(series: DataFrame) -> DataFrame:
    """Add ``drawdown``: the fall from the running maximum as a share of it; null at maximum 0."""
    return series.withColumn(
        "drawdown",
        F.try_divide(F.col("running_max") - F.col("value"), F.col("running_max")),
    )


def chronological(prices: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Points numbered in time order per ticker (``observation``)."""
    return running(prices, hot_rows=hot_rows).drop("previous", "running_max")


def rolling(prices: DataFrame, size: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mean, sample deviation, minimum and maximum over the last ``size`` points of each point.

    Cold tickers use one window. Hot tickers are numbered first and cut into chunks of equal
    length; the last ``size - 1`` points of a chunk are handed to the next one as well, which is
    all its first points need. Frames of more than ``SHORT_FRAME`` points are put together from block
    parts, so that the work per point does not grow with ``size``.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    whole = {"chunk": F.lit(0).cast("bigint"), "own": F.lit(True)}
    if hot_rows is None:
        chunked = prices.withColumns(whole)
    else:
        cold, pieces = split_by_heat(prices, hot_rows)
        chunked = cold.withColumns(whole)
        if pieces is not None:
            chunked = chunked.unionByName(_chunks(pieces, size, hot_rows).select(*chunked.columns))
    found = _sliding(chunked, size) if size <= SHORT_FRAME else _by_blocks(chunked, size)
    return found.where("own").drop("chunk", "own")


def _sliding(chunked: DataFrame, size: int) -> DataFrame:
    """Rolling columns by a sliding frame, which looks at ``size`` points for each point."""
    frame = (
        f"PARTITION BY ticker, chunk {_OLDEST_FIRST} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW"
    )
    return chunked.selectExpr(
        "*",
        f"avg(value) OVER ({frame}) AS rolling_mean",
        f"stddev_samp(value) OVER ({frame}) AS rolling_std",
        f"min(value) OVER ({frame}) AS rolling_min",
        f"max(value) OVER ({frame}) AS rolling_max",
    )


def _by_blocks(chunked: DataFrame, size: int) -> DataFrame:
    """Rolling columns from blocks of ``size`` points.

    A frame is the head of its last point's block and the tail of the block before. Heads and tails
    are running aggregates within a block, one in either direction; the tail that belongs to a
    point stands ``size - 1`` points earlier. Sums never leave a block, so nothing large is subtracted.
    All windows share the exchange on the ticker.
    """
    series = f"PARTITION BY ticker, chunk {_OLDEST_FIRST}"
    numbered = chunked.selectExpr("*", f"bigint(row_number() OVER ({series})) - 1 AS _i")
    block = f"PARTITION BY ticker, chunk, _i div {size} ORDER BY _i"

    def part(frame: str) -> str:
        over = f"OVER ({frame} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return (
            f"struct(count(value) {over} AS n, avg(value) {over} AS mean, var_pop(value) {over} AS spread, "
            f"min(value) {over} AS low, max(value) {over} AS high)"
        )

    parts = numbered.selectExpr("*", f"{part(block)} AS _head").selectExpr("*", f"{part(block + ' DESC')} AS _rest")
    lagged = f"lag(_rest, {size - 1}) OVER (PARTITION BY ticker, chunk ORDER BY _i)"
    met = parts.selectExpr("*", f"if(_i % {size} = {size - 1}, NULL, {lagged}) AS _tail")
    both = met.selectExpr(
        "*", "_head.n AS _n", "coalesce(_tail.n, 0L) AS _m",
        "coalesce(_head.mean, 0D) AS _a", "coalesce(_tail.mean, 0D) AS _b",
    ).selectExpr(
        "*",
        "coalesce(_n * _head.spread, 0D) + coalesce(_m * _tail.spread, 0D) "
        "+ coalesce(try_divide(double(_n) * _m, _n + _m), 0D) * power(_a - _b, 2) AS _squares",
    )
    return both.select(
        *(F.col(f"`{c}`") for c in chunked.columns),
        F.expr("try_divide(_n * _a + _m * _b, _n + _m) AS rolling_mean"),
        F.expr("if(_n + _m > 1, sqrt(_squares / (_n + _m - 1)), NULL) AS rolling_std"),
        F.expr("least(_head.low, _tail.low) AS rolling_min"),
        F.expr("greatest(_head.high, _tail.high) AS rolling_max"),
    )


def _chunks(pieces: DataFrame, size: int, hot_rows: int) -> DataFrame:
    """Placed points with the chunks they take part in; ``own`` marks the one they belong to."""
    length = max(hot_rows, size)
    within = f"row_number() OVER (PARTITION BY {', '.join(_PIECE)} {_OLDEST_FIRST}) AS _nth"
    numbered = _with_carry(pieces.selectExpr("*", within), pieces)
    index = F.col("prior_count") + F.col("_nth") - 1
    home = F.floor(index / length)
    shared = (index % length) >= length - (size - 1)
    return (
        numbered.withColumn("home", home)
        .withColumn("chunk", F.explode(F.when(shared, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn("own", F.col("home") == F.col("chunk"))
    )
