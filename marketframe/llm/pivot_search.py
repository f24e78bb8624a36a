"""Exact top-k inner products with pivot-table elimination.

Distances to a set of pivots are computed once per vector. For a query ``q`` and a vector ``x`` the
triangle inequality gives ``|d(q, p) - d(x, p)|`` as a lower bound of their distance for every pivot,
and the largest of these bounds the inner product from above, ``(q.q + x.x - bound ** 2) / 2``.
Candidates are evaluated in the order of that bound until it falls below the k-th best score, so the
result is exact whatever the pivots; the origin is always one of them.

A stated query set meets all vectors in blocks: both sides are cut by hash into blocks of bounded
size, a task holds one block of each, and only ``k`` rows per query leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors, and of queries.
BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Vectors that pivots are chosen from (those of smallest hash), and their number.
PIVOT_SAMPLE, PIVOTS = 2_048, 32


def choose_pivots(sample: np.ndarray, number: int = PIVOTS) -> np.ndarray:
    """The origin, then the vectors farthest from all chosen ones, one after another."""
    chosen = [np.zeros(sample.shape[1])]
    nearest = np.linalg.norm(sample, axis=1)
    while len(chosen) < number and len(sample) and nearest.max() > 0:
        chosen.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, np.linalg.norm(sample - chosen[-1], axis=1))
    return np.array(chosen)


def best_in_block(
    ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, query_id: int, query: np.ndarray, row: np.ndarray, k: int
) -> list[tuple[int, float]]:
    """The ``k`` best ``(id, score)`` of a block, ties to the smaller id; ``table`` and ``row`` hold
    the distances to the pivots."""
    bound = np.abs(table - row).max(axis=1)
    norms = table[:, 0] ** 2
    above = (norms + row[0] ** 2 - bound**2) / 2
    slack = 1e-9 * (norms.max(initial=0) + row[0] ** 2 + 1)
    order = np.argsort(-above, kind="stable")
    best: list[tuple[float, int]] = []  # (-score, id), sorted
    at, step = 0, 64
    while at < len(order) and (len(best) < k or above[order[at]] + slack >= -best[-1][0]):
        some = order[at:at + step]
        some = some[ids[some] != query_id]
        scores = vectors[some] @ query
        if len(best) == k:
            good = scores >= -best[-1][0]
            some, scores = some[good], scores[good]
        best = sorted([*best, *zip((-scores).tolist(), ids[some].tolist())])[:k]
        at, step = at + step, min(2 * step, 1024)
    return [(i, -s) for s, i in best]


def clean(df: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """``(id, vec array<double>)``: rows with an id and a vector of finite numbers, each once."""
    doubles = vector.cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), doubles.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(finite, F.lit(False))).distinct()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, id, score double)``: for every row of ``vectors`` ``(id, vec)`` with
    ``is_query``, the ``k`` other rows of largest inner product (all, if fewer), ties to the smaller id.

    Rows with the query's own id are not its candidates. Vectors of different lengths have no inner
    product and do not meet. Of rows that share an id, each distinct vector is a row of its own;
    repeated rows count once (see ``clean``). An empty table, or one without queries, gives no rows.
    """
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(counts["n"] / BLOCK)), max(1, math.ceil(counts["q"] / QUERY_BLOCK))
    sample: dict[int, list] = {}
    for row in vectors.orderBy(F.xxhash64("id", "vec"), "id").limit(PIVOT_SAMPLE).collect():
        sample.setdefault(len(row["vec"]), []).append(row["vec"])
    chosen = {d: choose_pivots(np.array(v, float).reshape(len(v), d), pivots) for d, v in sample.items()}

    def distances(batches):
        for batch in batches:
            table = []
            for vec in batch.column(1):
                v = np.array(vec.as_py(), float)
                table.append(np.linalg.norm(chosen.get(len(v), np.zeros((1, len(v)))) - v, axis=1).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table, pa.list_(pa.float64()))], ["id", "vec", "query", "table"])

    kept = vectors.select("id", "vec", is_query.alias("query"))
    tabled = kept.mapInArrow(distances, "id long, vec array<double>, query boolean, table array<double>").select(
        "*", F.size("vec").alias("dim"), F.xxhash64("id", "vec").alias("h")
    )
    left = tabled.select(
        "dim", F.pmod("h", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "id", "vec", "table"
    )
    right = tabled.where("query").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod("h", F.lit(query_blocks)).cast("int").alias("part"), "id", "vec", "table", "h",
    )

    def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)

    def meet(vecs: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if vecs.num_rows and queries.num_rows:
            ids = vecs.column("id").to_numpy()
            x, table = matrix(vecs.column("vec"), vecs.num_rows), matrix(vecs.column("table"), vecs.num_rows)
            q, rows = matrix(queries.column("vec"), queries.num_rows), matrix(queries.column("table"), queries.num_rows)
            for i, (query, h) in enumerate(zip(queries.column("id").to_pylist(), queries.column("h").to_pylist())):
                out += [(query, h, *found) for found in best_in_block(ids, x, table, query, q[i], rows[i], k)]
        kinds = [("query_id", pa.int64()), ("h", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns)})

    keys = ["dim", "block", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, h long, id long, score double")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
