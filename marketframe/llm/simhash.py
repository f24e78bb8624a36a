"""SimHash near-duplicates by segment bit counts.

A fingerprint's bit is 1 where more than half of its shingles' hashes have a 1. Fingerprints link when
at most ``max_bits`` bits differ; documents of one fingerprint are one node, so copies cost nothing.

*Embedding.* A fingerprint is cut into 32 segments of two bits and mapped to the segments' bit counts.
The Manhattan distance of two such vectors never exceeds the number of differing bits. Counts are
written in unary (0, 1, 2 as 00, 01, 11), which makes a vector one long and the Manhattan distance
the number of differing bits of two longs.

*Grid range join.* The segments form ``GROUPS`` groups. Vectors within Manhattan distance
``max_bits`` differ in at most that many groups, so they agree in at least ``GROUPS - max_bits`` of
them: they share the grid cell that some such choice of groups spans. Cells are equi-join keys; pairs
of a cell are cut by the lower bound and then verified on the fingerprints.

*Crowded cells.* Near copies fill one cell with fingerprints that are all close to each other, where
pairs would grow with the square. Two fingerprints at most ``2 r`` bits apart have a fingerprint
between them, at most ``r`` from each; so members of a crowded cell send themselves to all
fingerprints within ``r`` and link to the smallest one met there. That finds every link's component
with a number of rows that is linear in the members. Nothing is dropped; only the road differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import materialized

from .components import connected_components

#: Members of a grid cell from which on links go over midpoints.
CROWDED = 1024
#: Expected partners of a fingerprint in a cell that are none; they cost a comparison, and fewer cost
#: more cells per fingerprint.
STRANGERS = 16

_LOW = 0x5555555555555555


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle, a text without words has none."""
    import xxhash

    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    last = ends[min(words, len(parts)) - 1:]
    first = np.concatenate([[0], ends[:len(last) - 1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], seed) for i, j in zip(first.tolist(), last.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed long; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        some = hashes[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, words: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp long)``: A-Z lower-cased, words cut at ASCII white space, shingles of ``words``
    words joined by blanks and hashed by XXH64, repeats included.

    A shorter text is one shingle; a text without words, or null, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, in unary."""
    shifted = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW)
    either, both = fp.bitwiseOR(shifted).bitwiseAND(low), fp.bitwiseAND(shifted).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _masks(groups: int, kept: int) -> list[int]:
    """For each choice of ``kept`` of the groups, the bits of their segments (as signed longs)."""
    edges = [2 * round(32 * g / groups) for g in range(groups + 1)]
    spans = [((1 << edges[g + 1]) - 1) & ~((1 << edges[g]) - 1) for g in range(groups)]
    masks = [sum(spans[g] for g in some) for some in combinations(range(groups), kept)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def grid(n: int, max_bits: int) -> int:
    """Groups of segments: as few as leave an unrelated fingerprint ``STRANGERS`` partners per cell at
    most. Two unrelated vectors agree in a segment with probability 3/8."""
    for groups in range(max_bits + 1, 2 * max_bits + 4):
        if n * 0.375 ** (32 * (groups - max_bits) / groups) <= STRANGERS:
            return groups
    return 2 * max_bits + 4


def links(nodes: DataFrame, n: int, max_bits: int = 4, crowded: int = CROWDED, table: Callable = materialized) -> DataFrame:
    """``(a, b)``: enough pairs of distinct fingerprints ``fp`` at most ``max_bits`` apart to connect
    all that are linked; ``n`` is their number (it sets the grid, not the result), ``table`` writes an
    intermediate table."""
    if max_bits % 2:
        raise ValueError("the bound on differing bits must be even")
    groups = grid(n, max_bits)
    cells = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(mask)).alias("cell"))
                for i, mask in enumerate(_masks(groups, groups - max_bits))
            )
        )
    )
    vectors = nodes.select("fp", counts(F.col("fp")).alias("counts"))
    placed = vectors.select("fp", "counts", cells.alias("key")).select("fp", "counts", "key.choice", "key.cell")
    sizes = placed.groupBy("choice", "cell").agg(F.count("*").alias("size")).where("size > 1")
    sizes = table(sizes, "simhash-cells")
    small = placed.join(sizes.where(F.col("size") <= crowded), ["choice", "cell"]).select("choice", "cell", "fp", "counts")
    left, right = (small.select("choice", "cell", F.col("fp").alias(f), F.col("counts").alias(c)) for f, c in ("ax", "by"))
    pairs = (
        left.join(right, ["choice", "cell"])
        .where("a < b")
        .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    full = placed.join(sizes.where(F.col("size") > crowded), ["choice", "cell"]).select("fp").distinct()
    return pairs.unionByName(_over_midpoints(full, max_bits)).distinct()


def _over_midpoints(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of all fingerprints at most ``max_bits`` (an even number) apart, in stars around what
    lies between them: any two members of a star are within the bound."""
    reach = max_bits // 2
    flips = [0] + [sum(1 << b for b in bits) for r in range(1, reach + 1) for bits in combinations(range(64), r)]
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.array(flips, np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 64):
                some = own[at:at + 64]
                between = (some[:, None] ^ change[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(change))), pa.array(between)], ["fp", "mid"])

    # Few rows become thousands each: they are spread by value first.
    near = fps.repartition(F.col("fp")).mapInArrow(emit, "fp long, mid long")
    met = near.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mid", "a")
    return near.join(met, "mid").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    max_bits: int = 4,
    crowded: int = CROWDED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, fp long, component_id)``: one row per document; ``component_id`` is the smallest
    document id reachable over links of at most ``max_bits`` differing bits.

    Null texts and texts without words have fingerprint 0 and link like others; repeated rows keep
    their number; rows with a null id get a component like others, whose id is the smallest known
    one, null if there is none; an empty table gives an empty result; other columns are not read.
    """
    prints = materialized(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash-prints")
    nodes = materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    edges = links(nodes.select("fp"), max(nodes.count(), 1), max_bits, crowded)
    labels = connected_components(materialized(edges, "simhash-links"))  # (node, root) of linked ones
    rooted = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
