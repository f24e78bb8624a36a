"""Spelling variants against brute force over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marketframe.llm import spelling


def _counts(rows, slip=31):
    table = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            table[run] += 1
    return {w: n for w, n in table.items() if len(w) >= 7 and n >= 2}


def _distance_is_one(a, b):
    """Plain definition: every single edit of ``a`` tried out."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def _expected(rows, slip=31):
    words = _counts(rows, slip)
    found = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if _distance_is_one(w, v)]
        best = min(near, default=None)
        form = best if best and -best[0] >= 10 * n else None
        found[w] = (n, form[1] if form else None, -form[0] if form else None, len(near))
    def root(w):
        return w if found[w][1] is None else root(found[w][1])
    return {w: (*v, root(w)) for w, v in found.items()}


def _rows(seed=3):
    rng = random.Random(seed)
    letters = "abcdéÀz"
    stems = ["".join(rng.choices(letters, k=rng.randint(7, 10))) for _ in range(25)]
    words = list(stems)
    for s in stems:
        for _ in range(6):
            at = rng.randrange(len(s))
            words.append(rng.choice([s[:at] + s[at + 1:], s[:at] + rng.choice(letters) + s[at:], s[:at] + rng.choice(letters) + s[at + 1:]]))
    weights = [60] * len(stems) + [rng.choice([1, 1, 3]) for _ in words[len(stems):]]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=120)) + ".") for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "!? \n"), (None, "abcdabcd abcdabcd"), (7, rows[7][1]), (7, rows[7][1]), (53, "ab" * 3000 + " " + "ab" * 3000 + " " + "ab" * 2999 + " " + "ab" * 2999 + "b")]


@pytest.mark.parametrize("crowded", [spelling.CROWDED, 8])  # 8: every key is cut into chunks
def test_variants_equal_brute_force(docs, crowded):
    rows = _rows()
    found = spelling.variants(docs(rows), crowded=crowded).collect()
    assert len(found) == len({r.word for r in found})
    assert {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in found} == _expected(rows)
    assert any(r.form for r in found) and any(r.n_near > 3 for r in found)


def test_number_of_groups_changes_nothing(docs, monkeypatch):
    rows = _rows(4)
    monkeypatch.setattr(spelling, "number_of_groups", lambda words: 6)
    found = spelling.variants(docs(rows), slip=None).collect()
    assert {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in found} == _expected(rows, None)


def test_chains_of_forms_lead_to_one_root(docs):
    words = ["abcdefghijk"] * 4000 + ["abcdefghij"] * 400 + ["abcdefghi"] * 40 + ["abcdefgh"] * 4
    found = {r.word: (r.form, r.root) for r in spelling.variants(docs([(1, " ".join(words))]), slip=None).collect()}
    assert found["abcdefgh"] == ("abcdefghi", "abcdefghijk")
    assert found["abcdefghijk"] == (None, "abcdefghijk")


def test_ties_go_to_the_first_word_and_empty_tables_stay_empty(docs):
    text = " ".join(["aaaaaaab"] * 20 + ["aaaaaaac"] * 20 + ["aaaaaaa"] * 2)
    found = {r.word: r for r in spelling.variants(docs([(1, text)]), slip=None).collect()}
    assert found["aaaaaaa"].form == "aaaaaaab" and found["aaaaaaa"].n_near == 2
    assert spelling.variants(docs([])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs([]), ratio=1)


def test_squared_distances_bound_edits():
    rng = random.Random(1)
    signatures = spelling.Signatures(5)
    for _ in range(500):
        a = "".join(rng.choices("abéz", k=rng.randint(1, 12)))
        b = "".join(rng.choices("abéz", k=rng.randint(1, 12)))
        assert spelling.one_edit(a, b) == _distance_is_one(a, b)
        if _distance_is_one(a, b):
            x, y = spelling.counts([a, b])
            assert ((x - y) ** 2).sum() == 2 - abs(len(a) - len(b))
            choice = signatures.agreed(x[None], y[None])[0]
            assert choice >= 0 and np.array_equal(*(signatures.keys(v[None])[:, choice] for v in (x, y)))
