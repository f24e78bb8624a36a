"""A Merkle manifest of a dataset, with a version of the tree for every changed row.

Rows are leaves, ordered by id within their source; every ``ARITY`` consecutive nodes have a parent,
which is the hash of their digests. The subroots of all sources, in order of source, form one more tree
whose root stands for the dataset.

*Aligned blocks.* ``ARITY ** LEVELS`` consecutive leaves are a block: a task builds their nodes on its
own, and the block's root is a leaf of the next layer. So a source of any size is a few layers of
bounded blocks, no task holds a whole source, and a hot source is many blocks. Dense positions come
from range partitions that are written once.

*Path copying.* Within a block the tree is persistent: a changed leaf makes a version that copies its
ancestors and shares every other node. A version's block root goes on through the path of its block,
which the layers above hand down by a join on (source, block), one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import materialized

#: Children of a node, and levels of a block: 729 leaves.
ARITY, LEVELS = 3, 6

_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class VersionedTree:
    """A persistent tree over ordered leaves; nodes are numbered and never change."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = [list(range(len(leaves)))]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([self._node(tuple(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
        self.root = self.levels[-1][0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest(*(self.digests[c] for c in children)))
        self.children.append(children)
        return len(self.digests) - 1

    def changed(self, root: int, position: int, leaf: str) -> int:
        """The root of a version of ``root`` with another leaf; only its ancestors are new nodes."""
        node, path = root, []
        for level in range(len(self.levels) - 1, 0, -1):
            slot = position // ARITY ** (level - 1) % ARITY
            path.append((node, slot))
            node = self.children[node][slot]
        self.digests.append(leaf)
        self.children.append(())
        new = len(self.digests) - 1
        for node, slot in reversed(path):
            old = self.children[node]
            new = self._node((*old[:slot], new, *old[slot + 1:]))
        return new

    def siblings(self) -> list[list[tuple[str, str]]]:
        """For each level below the root and each of its first version's nodes, the digests to its left
        and right under the same parent."""
        found = []
        for nodes in self.levels[:-1]:
            level = []
            for i in range(0, len(nodes), ARITY):
                run = [self.digests[n] for n in nodes[i:i + ARITY]]
                level += [("".join(run[:j]), "".join(run[j + 1:])) for j in range(len(run))]
            found.append(level)
        return found


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings, level by level, lead to."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def _levels(n: int, height: int) -> int:
    """Levels of a block in a tree (or layer) of ``n`` nodes: up to its root, or the block's whole height."""
    if n > ARITY**height:
        return height
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def leaf_text(values: Sequence[Column]) -> Column:
    """What a leaf hashes: each value as its length in bytes, a colon and its text; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _positions(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``, their place within ``tree`` in that order, and ``n``, the tree's size. Range
    partitions are written once; a place is the one in its partition plus what lies before."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialized(
        ranged.withColumns({"piece": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), label
    )
    held = ranged.groupBy("tree", "piece").agg(F.min("nth").alias("lo"), F.count("*").alias("held"))
    before = "PARTITION BY tree ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    starts = held.selectExpr(
        "tree", "piece", f"coalesce(sum(held) OVER ({before}), 0L) - lo AS shift", "sum(held) OVER (PARTITION BY tree) AS n"
    )
    joined = ranged.join(starts, ["tree", "piece"])
    return joined.withColumn("at", F.col("nth") + F.col("shift")).drop("piece", "nth", "shift")


def _blocks(nodes: DataFrame, members: list[str], height: int, label: str) -> DataFrame:
    """One row per block: ``(tree, block, n, members)``, at most ``ARITY ** height`` members in order."""
    block = F.expr(f"at div {ARITY**height}").alias("block")
    grouped = nodes.groupBy("tree", block).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *members))).alias("members")
    )
    return materialized(grouped, label)


def _each_block(blocks: DataFrame, work: Callable[[dict], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows that ``work`` makes of each block, a batch per few blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 8):
                rows = [row for block in batch.slice(begin, 8).to_pylist() for row in work(block)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.mapInArrow(run, ddl)


def _tree(block: dict, height: int) -> VersionedTree:
    return VersionedTree([m["digest"].hex() for m in block["members"]], _levels(block["n"], height))


def _roots(blocks: DataFrame, height: int) -> DataFrame:
    """Block roots as nodes of the next layer."""

    def work(block: dict) -> Iterator[tuple]:
        tree = _tree(block, height)
        yield block["tree"], block["block"], -(-block["n"] // ARITY**height), bytes.fromhex(tree.digests[tree.root])

    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    return _each_block(blocks, work, schema, "tree string, at long, n long, digest binary")


def _climb(blocks: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The layers of blocks up to those whose root is the tree's, and those roots ``(tree, digest)``.
    Trees that are done go along as single nodes."""
    layers = [blocks]
    while True:
        nodes = materialized(_roots(layers[-1], height), "merkle-roots")
        if nodes.where("n > 1").isEmpty():
            return layers, nodes.select("tree", "digest")
        layers.append(_blocks(nodes, ["digest"], height, "merkle-layer"))


def _whole_path(tree: VersionedTree, at: int, siblings: list[list[tuple[str, str]]], above: list[dict]) -> list[tuple[str, str]]:
    own = [siblings[level][at // ARITY**level] for level in range(len(siblings))]
    return own + [(a["left"], a["right"]) for a in above]


def _paths(blocks: DataFrame, height: int) -> DataFrame:
    """``(tree, at, path, subroot)`` of every member, from blocks with the path ``above`` them."""

    def work(block: dict) -> Iterator[tuple]:
        tree = _tree(block, height)
        siblings = tree.siblings()
        for i, m in enumerate(block["members"]):
            yield block["tree"], m["at"], _whole_path(tree, i, siblings, block["above"]), block["subroot"]

    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", _PATH_TYPE), ("subroot", pa.binary())])
    return _each_block(blocks, work, schema, f"tree string, at long, path {_PATH}, subroot binary")


def _descend(layers: list[DataFrame], roots: DataFrame, height: int) -> DataFrame:
    """The blocks of the lowest layer with ``above``, the path from their root upwards, and ``subroot``;
    ``roots`` is ``(tree, at, path, subroot)`` of the trees' roots."""
    paths = roots
    for layer in reversed(layers):
        up = paths.select("tree", F.col("at").alias("block"), F.col("path").alias("above"), "subroot")
        with_path = layer.join(up, ["tree", "block"])
        if layer is layers[0]:
            return with_path
        paths = _paths(with_path, height)
    raise AssertionError("there is always a lowest layer")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    changes: dict[str, Column] | None = None,
    where: Column | None = None,
    height: int = LEVELS,
) -> DataFrame:
    """``(doc_id, source, position, leaf, path, subroot, root, changed_leaf, changed_root, verified)``
    for every row.

    ``path`` lists the siblings left and right (digests joined) level by level from the leaf to
    ``root``. ``changes`` gives other values for some fields, in rows that meet ``where``; such a row's
    ``changed_leaf`` makes a version of the tree whose root is ``changed_root``. Rows without a change
    are folded over their path instead, which checks the path. ``verified`` tells whether that root is
    the dataset's. ``height`` is that of a block, which bounds a task's memory and changes no result.

    Null fields hash as ``-``; rows with a null id come first in their source and rows with a null
    source form the first tree, as sources of their own. Rows of one id are ordered by their leaf;
    repeated rows are leaves of their own, at neighbouring places. A null ``where`` means no change. An
    empty table gives an empty result; other columns are not read.
    """
    known = F.col(source_col).cast("string")
    now = leaf_text([F.col(f) for f in fields])
    then = leaf_text([(changes or {}).get(f, F.col(f)) for f in fields])
    meets = F.coalesce(where if where is not None else F.lit(bool(changes)), F.lit(False))
    leaves = materialized(
        docs.select(
            F.coalesce(F.concat(F.lit(":"), known), F.lit("-")).alias("tree"),  # "-" sorts before ":"
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(now, 256)).alias("digest"),
            F.when(meets, F.unhex(F.sha2(then, 256))).alias("changed"),
            F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart, so that they spread
        ),
        "merkle-leaves",
    )
    placed = _positions(leaves, ["id", "digest", "row"], "merkle-places")
    layers, subroots = _climb(_blocks(placed, ["digest", "id", "changed"], height, "merkle-blocks"), height)

    ordered = _positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "merkle-sources")
    above, top = _climb(_blocks(ordered, ["digest", "name"], height, "merkle-top"), height)
    none = F.lit(None).cast(_PATH)
    empty = F.coalesce(none, F.array().cast(_PATH))
    start = top.select("tree", F.lit(0).cast("long").alias("at"), empty.alias("path"), F.col("digest").alias("subroot"))
    sources = _source_paths(_descend(above, start, height), height)
    root = top.select(F.lower(F.hex("digest"))).head()
    return _rows(_descend(layers, sources, height), height).select(
        "doc_id", "source", "position", "leaf", "path", "subroot", F.lit(root[0] if root else None).alias("root"),
        "changed_leaf", "changed_root", (F.col("changed_root") == F.lit(root[0] if root else None)).alias("verified"),
    )


def _source_paths(blocks: DataFrame, height: int) -> DataFrame:
    """``(tree, at, path, subroot)`` of every source's root, for the descent through its layers."""

    def work(block: dict) -> Iterator[tuple]:
        tree = _tree(block, height)
        siblings = tree.siblings()
        for i, m in enumerate(block["members"]):
            yield m["name"], 0, _whole_path(tree, i, siblings, block["above"]), m["digest"]

    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", _PATH_TYPE), ("subroot", pa.binary())])
    return materialized(_each_block(blocks, work, schema, f"tree string, at long, path {_PATH}, subroot binary"), "merkle-paths")


def _rows(blocks: DataFrame, height: int) -> DataFrame:
    def work(block: dict) -> Iterator[tuple]:
        tree = _tree(block, height)
        siblings = tree.siblings()
        above = [(a["left"], a["right"]) for a in block["above"]]
        source = block["tree"][1:] if block["tree"] != "-" else None
        subroot = block["subroot"].hex()
        for i, m in enumerate(block["members"]):
            leaf = m["digest"].hex()
            path = _whole_path(tree, i, siblings, block["above"])
            if m["changed"] is None:
                other, result = None, fold(leaf, path)
            else:
                other = m["changed"].hex()
                result = fold(tree.digests[tree.changed(tree.root, i, other)], above)
            yield m["id"], source, m["at"], leaf, path, subroot, other, result

    schema = pa.schema([
        ("doc_id", pa.int64()), ("source", pa.string()), ("position", pa.int64()), ("leaf", pa.string()), ("path", _PATH_TYPE),
        ("subroot", pa.string()), ("changed_leaf", pa.string()), ("changed_root", pa.string()),
    ])
    ddl = f"doc_id long, source string, position long, leaf string, path {_PATH}, subroot string, changed_leaf string, changed_root string"
    return _each_block(blocks, work, schema, ddl)


def proof(path: str = "path") -> Column:
    """The siblings' digests, left to right, level by level, as one text."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda level: F.array(level["left"], level["right"]))))
