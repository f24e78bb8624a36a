"""The manifest against a plain tree over lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketframe.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DDL = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, digest string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _climb(nodes):
    """All levels, and for each leaf the siblings' digests in order."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h(*below[i:i + 3]) for i in range(0, len(below), 3)])
    return levels


def _fold(levels, at, cur):
    proof = ""
    for level in levels[:-1]:
        first = at // 3 * 3
        run = level[first:first + 3]
        left, right = "".join(run[:at - first]), "".join(run[at - first + 1:])
        proof, cur, at = proof + left + right, _h(left, cur, right), at // 3
    return proof, cur


def _expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[4]), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_climb([leaf for *_, leaf, _ in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources]
    top = _climb([t[-1][0] for t in trees])
    found = Counter()
    for place, (source, tree) in enumerate(zip(sources, trees)):
        for at, (_, _, leaf, row) in enumerate(sorted(by_source[source], key=lambda x: x[:3])):
            changed = row[4] is not None and row[0] is not None and row[0] % 2 == 0
            other = _leaf(row, row[4].replace("\n", "")) if changed else leaf
            proof, subroot = _fold(tree, at, other)
            more, root = _fold(top, place, subroot)
            found[row[0], leaf, tree[-1][0], top[-1][0], _h(proof + more), root, root == top[-1][0]] += 1
    return found


def _found(spark, rows, height=merkle.LEVELS):
    docs = spark.createDataFrame([(*r, "t", 1, "d") for r in rows], DDL)
    text = F.replace("text", F.lit("\n"), F.lit(""))
    got = merkle.manifest(docs, changes={"text": text}, where=F.col("doc_id") % 2 == 0, height=height)
    got = got.withColumn("proof", F.sha2(merkle.proof(), 256)).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.changed_root, r.verified) for r in got)


def _rows(n, sources, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), i % 7, "\n".join(rng.choices("abé", k=rng.randint(0, 4)))) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [0, 1, 4, 28])
def test_one_source_equals_a_plain_tree(spark, n):
    rows = _rows(n, ["s"])
    assert _found(spark, rows) == (_expected(rows) if n else Counter())


def test_layers_of_small_blocks_equal_a_plain_tree(spark):
    rows = _rows(90, ["hot"] * 8 + ["", "é", "z", None, "-", ":", "ab", "a", "b", "c", "d"])
    assert _found(spark, rows, height=1) == _expected(rows)


def test_nulls_repeated_rows_and_ties(spark):
    rows = _rows(20, [None, "s"]) + [(4, "s", "en", 1, "same\n")] * 5 + [(None, "s", None, None, None)] * 3
    rows += [(4, "s", "en", 1, "other"), (9, None, None, None, ""), (10, "long", "en", 1, "line\n" * 20_000)]
    found = _found(spark, rows)
    assert found == _expected(rows)
    assert any(not verified for *_, verified in found) and any(verified for *_, verified in found)


def test_versions_share_untouched_nodes():
    leaves = [_h(str(i)) for i in range(700)]
    tree = merkle.VersionedTree(leaves, merkle.LEVELS)
    before, root = len(tree.digests), tree.root
    for at in (0, 350, 699):
        other = tree.changed(root, at, "x")
        assert len(tree.digests) == before + 1 + merkle.LEVELS  # the leaf and its ancestors
        before = len(tree.digests)
        changed = [*leaves[:at], "x", *leaves[at + 1:]]
        assert tree.digests[other] == _climb(changed)[-1][0]
        assert sum(a not in tree.children[root] for a in tree.children[other]) == 1
    assert tree.digests[root] == _climb(leaves)[-1][0]


def test_any_changed_digest_breaks_the_proof():
    levels = _climb([_h(str(i)) for i in range(30)])
    tree = merkle.VersionedTree(levels[0], 4)
    path = [tree.siblings()[level][17 // 3**level] for level in range(4)]
    assert merkle.fold(levels[0][17], path) == levels[-1][0]
    for level, (left, right) in enumerate(path):
        for spoiled in ((left[:-1] + "x", right), (left, right[:-1] + "x")):
            if spoiled != (left, right):
                assert merkle.fold(levels[0][17], [*path[:level], spoiled, *path[level + 1:]]) != levels[-1][0]


def test_without_changes_every_row_verifies(spark):
    rows = _rows(40, ["a", "b"])
    docs = spark.createDataFrame([(*r, "t", 1, "d") for r in rows], DDL)
    got = merkle.manifest(docs).collect()
    assert all(r.verified and r.changed_leaf is None for r in got) and len(got) == 40
