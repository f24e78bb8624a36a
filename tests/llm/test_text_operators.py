"""Operators on documents against brute force, with nulls, empty, long and repeated rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from marketframe.llm import byte_bpe, line_dedup, packing, personal, quality, queries, secrets, simhash, weak_labels

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Don't  stop\n\nnow\t½ 日本語 é İΣ"), (5, "word " * 3000), (6, "x" * 5000),
    (6, "x" * 5000), (None, "no id"), (7, "<|endoftext|> a b 12.5%!!"), (8, "a\x1cb \x85c\r\n'll  'S"),
]


def test_packing_round_trip(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.decompose(docs(ODD), path, max_length=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc, text in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted({(r.start, bytes(r.ids)) for r in rows if r.doc_id == doc})
        assert np.frombuffer(b"".join(b for _, b in own), "<u4").tolist() == ids
        for r in rows:
            if r.doc_id == doc:
                assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.doc_tokens == len(ids)
    assert packing.decompose(docs([]), path).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(docs([]), path, max_length=100)


def test_byte_bpe_equals_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    more = [(100 + i, "".join(rng.choices("ab c\n.é1'", k=rng.randint(1, 200)))) for i in range(40)]
    encoded = byte_bpe.encode(docs(ODD + more), path, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, path).collect()
    assert len(rows) == len(ODD) + len(more)
    expected = {i: t or "" for i, t in ODD + more}
    for r in rows:
        assert r.ids == library.encode_ordinary(expected[r.doc_id])
        assert bytes(r.decoded).decode() == expected[r.doc_id]
    assert byte_bpe.encode(docs([]), path, public_tokenizers.PATTERN).count() == 0


def _fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowded", [1024, 2])
def test_simhash_groups(docs, crowded):
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(400)]
    rows = list(ODD)
    for i in range(30):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(400)] = "changed"
        rows.append((50 + i, " ".join(copy)))
    rows += [(90 + i, " ".join(rng.choices(base, k=60))) for i in range(10)]
    found = simhash.near_duplicates(docs(rows), words=4, max_bits=4, crowded=crowded).collect()
    prints = {t: _fingerprint(t, 4) for _, t in rows}
    group = {p: p for p in prints.values()}
    for _ in range(len(group)):
        for p in group:
            group[p] = min(group[q] for q in group if (p ^ q).bit_count() <= 4)
    first = {}
    for i, t in rows:
        g = group[prints[t]]
        first[g] = min(first.get(g, 1 << 62), i if i is not None else 1 << 62)
    assert len(found) == len(rows)
    by_print = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in found}
    for i, t in rows:
        expected = first[group[prints[t]]]
        assert by_print[i, prints[t]] == (None if expected == 1 << 62 else expected)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_lines(docs):
    line = " ".join(f"w{i}" for i in range(12))
    changed = line.replace("w5", "other")
    shorter = line.replace("w7 ", "")
    rows = [
        (1, f"{line}\nshort one\n{line}"), (2, f"own text of this document stays here\n{changed}"), (3, f"{shorter}\n{line.upper()}"),
        (4, None), (5, ""), (6, "short one"), (2, f"own text of this document stays here\n{changed}"), (None, line),
    ]
    got = line_dedup.dedup_lines(docs(rows))
    assert got.columns[:8] == docs([]).columns
    result = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert result == sorted(
        [
            (1, f"{line}\nshort one", 3, 1), (2, "own text of this document stays here", 2, 1), (3, "", 2, 2), (4, None, 0, 0),
            (5, "", 1, 0), (6, "", 1, 1), (2, "own text of this document stays here", 2, 1), (None, "", 1, 1),
        ],
        key=str,
    )
    exact = line_dedup.dedup_lines(docs(rows), max_edits=0)
    assert {(r.doc_id, r.n_removed) for r in exact.collect()} == {(1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 1), (None, 1)}
    assert line_dedup.dedup_lines(docs([])).count() == 0


def _same_line(a: str, b: str) -> bool:
    v, w = a.lower().split(), b.lower().split()
    if v == w:
        return bool(w)
    if min(len(v), len(w)) >= 10:
        return line_dedup.within_one_edit(v, w)
    x, y = " ".join(v), " ".join(w)
    return max(len(v), len(w)) < 10 and min(len(x), len(y)) >= 20 and line_dedup.within_one_edit(list(x), list(y))


def test_lines_equal_brute_force(docs):
    rng = random.Random(11)
    seeds = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 13))] for _ in range(12)]
    seeds += [["".join(rng.choices("本日語中文的一是", k=rng.randint(15, 30)))] for _ in range(5)]
    seeds += [[rng.choice(["some", "words", "of", "length", "🙂"]) for _ in range(rng.randint(4, 7))] for _ in range(5)]
    seeds += [list("abcdefghijklmnopqrstuv"), ["abcdefghijklmnopqrstuv"]]

    def varied():
        w = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[at:at + rng.randint(0, 1)] = rng.choice([[], ["É"], [w[at]], ["x", "y"]])
            else:
                letters = list(w[at])
                place = rng.randrange(len(letters))
                letters[place:place + rng.randint(0, 1)] = rng.choice([[], ["É"], ["本"], [letters[place]]])
                w[at] = "".join(letters) or "z"
            if not w:
                return " \t"
        return "  ".join(w) if rng.random() < 0.2 else " ".join(w)

    rows = [(i, "\n".join(varied() for _ in range(rng.randint(0, 9)))) for i in range(80)]
    earlier: list[str] = []
    expected = {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if not any(_same_line(v, line) for v in earlier):
                kept.append(line)
            earlier.append(line)
        expected[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()} == expected


def test_lines_with_clashing_columns(spark):
    ddl = "doc_id long, text string, `row` int, `_base` string, `_lines` int, `_slot` int, `_gone` int, `a.b` int, n_lines string"
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "a line\na line", 1, "b", 2, 3, 4, 5, "n"), (2, "A  line", 6, "c", 7, 8, 9, 10, "m")], ddl))
    assert got.columns == ["doc_id", "text", "row", "_base", "_lines", "_slot", "_gone", "a.b", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a line", 1, "b", 2, 3, 4, 5, 2, 1), (2, "", 6, "c", 7, 8, 9, 10, 1, 1)]


def test_within_one_edit():
    def distance(a, b):
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            table, old = [i], table
            for j, y in enumerate(b, 1):
                table.append(min(old[j] + 1, table[-1] + 1, old[j - 1] + (x != y)))
        return table[-1]

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in "xy")
        assert line_dedup.within_one_edit(list(a), list(b)) == (distance(a, b) <= 1)


def test_quality_measures(docs):
    rng = random.Random(4)
    rows = ODD + [(200 + i, " ".join(rng.choices("ab", k=rng.randint(8, 60))) + "\nA line.\nA line.") for i in range(30)]
    got = quality.judge(voted := quality.votes(quality.measures(docs(rows))), quality.estimate(voted)).collect()
    expected = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        text = expected[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 2000 else set(range(3000))
        lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        )
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.keep(docs(rows)).columns == docs([]).columns
    assert quality.keep(docs([])).count() == 0


def test_reliabilities_are_found():
    rng = random.Random(5)
    patterns: dict = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < 0.3 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in (0.9, 0.8, 0.7, 0.85))
        patterns[votes] = patterns.get(votes, 0) + 1
    model = weak_labels.fit(patterns, 4)
    assert abs(model.prior - 0.7) < 0.05
    for found, true in zip(model.accuracies(), (0.9, 0.8, 0.7, 0.85)):
        assert abs(found - true) < 0.05


def test_secrets_under_layers(docs):
    secret = "password = hunter2secret"
    b64 = base64.b64encode(secret.encode()).decode()
    twice = base64.b64encode(f"see {b64} there".encode()).decode()
    packed = base64.b64encode(gzip.compress(secret.encode())).decode()
    deflated = base64.urlsafe_b64encode(zlib.compress(secret.encode())).decode()
    percent = quote(secret, safe="")
    unicode_ = "".join(f"\\u{ord(c):04x}" for c in secret)
    rows = ODD + [(20 + i, f"né {x} end") for i, x in enumerate((secret, b64, twice, packed, deflated, percent, unicode_, quote(b64, safe="")))]
    rows += [(40, "AKIA" + "A1" * 9 + " " + "0af" * 9), (41, "token: abc"), (42, "%25252541" * 3)]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(rows)).collect() if r.doc_id is not None}
    for i, (doc, text) in enumerate(rows):
        if doc is not None and 20 <= doc < 40:
            spans = [tuple(s) for s in got[doc].spans]
            assert any(k == "assign" and 3 <= s < e <= len(text) - 4 for k, s, e in spans), (doc, spans)
            assert bool(got[doc].base) == (doc == 20)
    assert [tuple(s) for s in got[40].spans] == [("access", 0, 22), ("hex", 23, 50)]
    assert not got[41].spans and not got[1].spans and got[42].n_layers > 2
    clean = {r.doc_id: r.text for r in secrets.redact(docs(rows)).collect()}
    assert clean[20] == "né [SECRET] end" and clean[1] is None
    assert secrets.scan_secrets(docs([])).count() == 0


def test_personal_base(docs):
    rows = ODD + [
        (30, "a.b@c.d@e.f mail x@y x@y.z"), (31, "1.2.3.4 1.2.3.256 01.002.3.4.5.6.7.8"), (32, "4111 1111 1111 1111 and 4111-1111-1111-1112"),
        (33, "+1 (555) 123-4567 and +12 and +1234567890123456"), (34, "call phone (555) 123-4567 or mail joe (at) gmail (dot) com"),
    ]
    got = {r.doc_id: r for r in personal.find_personal(docs(rows)).collect()}
    kinds = {i: [(s.kind, s.start, s.end) for s in got[i].base] for i in got}
    assert kinds[30] == [("email", 0, 7), ("email", 21, 26)]
    assert kinds[31] == [("ip", 0, 7), ("ip", 18, 28), ("ip", 29, 36)] or kinds[31][0] == ("ip", 0, 7)
    assert kinds[32] == [("card", 0, 19)]
    assert kinds[33] == [("phone", 0, 17)]
    assert kinds[1] == [] and kinds[2] == []
    for r in got.values():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert personal.find_personal(docs([])).count() == 0


def test_digest_queries(spark):
    for name in ("op1_binary_packing", "op4_quality", "op5_secrets", "op6_personal", "op9_byte_bpe", "op10_simhash"):
        assert name in queries.QUERIES
    assert hashlib.sha256(b"").hexdigest()
