"""The tokenization automaton against the tokenizers library and against plain merging."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketframe.llm import merge_automaton, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Don't  stop\n\nnow\t½ 日本語 é İΣ é x"), (5, "word " * 3000), (6, "x" * 5000),
    (6, "x" * 5000), (None, "no id"), (7, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> 12.5%!!"), (8, "a\x1cb \x85c\r\n'll  'S ſ ǅ"),
]


def _merged(word, merges):
    """Every merge in order, from left to right, over the whole word."""
    tokens = [*word[:-1], word[-1] + merge_automaton.WORD_END]
    for left, right in merges:
        out = []
        for t in tokens:
            if out and out[-1] == left and t == right:
                out[-1] = left + right
            else:
                out.append(t)
        tokens = out
    return tokens


@pytest.mark.parametrize("seed", range(12))
def test_random_merges_equal_plain_merging(seed):
    rng = random.Random(seed)
    end = merge_automaton.WORD_END
    tokens = [c + e for c in "abc" for e in ("", end)]
    merges = []
    while len(merges) < 25:  # pairs in any order, dead ones and runs of one letter among them
        pair = rng.choice([t for t in tokens if not t.endswith(end)]), rng.choice(tokens)
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    ids = {t: i for i, t in enumerate(tokens)}
    automaton = merge_automaton.Automaton(ids, merges)
    for _ in range(300):
        word = "".join(rng.choices("abc", [3, 1, 1], k=rng.randint(1, 14)))
        assert [tokens[i] for i in automaton.encode(word.encode())] == _merged(word, merges), word


def test_states_accept_tokenizations_only():
    merges = [("a", "b"), ("ab", "a"), ("b", "a")]
    tokens = ["a", "b", "a</w>", "b</w>", "ab", "aba", "ba"]
    automaton = merge_automaton.Automaton({t: i for i, t in enumerate(tokens)}, merges)
    place = {t: i for i, t in enumerate(automaton.tokens)}

    def accepts(*path):
        state = automaton.start
        for token in path:
            if not automaton._readable(state, place[token]):
                return False
            state = automaton.behind[place[token]]
        return True

    assert accepts("ab", "b") and accepts("ab", "ab") and accepts("aba", "a") and accepts("b", "b")
    assert not accepts("a", "b") and not accepts("ab", "a") and not accepts("b", "a") and not accepts("aba", "b")


def test_encoding_and_decoding_equal_the_library(docs):
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    more = [(100 + i, "".join(rng.choices("abcehtTÉß .,'<|1\n日", k=rng.randint(1, 150)))) for i in range(80)]
    encoded = merge_automaton.encode(docs(ODD + more), PATH)
    rows = merge_automaton.decode(encoded, PATH).collect()
    assert len(rows) == len(ODD) + len(more)
    expected = {i: t or "" for i, t in ODD + more}
    for r in rows:
        ids = tokenizer.encode(expected[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert merge_automaton.encode(docs([]), PATH).count() == 0
    assert merge_automaton.decode(encoded.selectExpr("doc_id", "cast(null as binary) ids"), PATH).where("decoded is null").count() == len(rows)


def test_small_tables_and_blocks_change_nothing(monkeypatch):
    monkeypatch.setattr(merge_automaton, "KEPT", 3)
    monkeypatch.setattr(merge_automaton, "KEPT_LENGTH", 4)
    small, plain = merge_automaton.TextEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("to be or not to be, that is the question", "a" * 300 + " b" * 50, "x<|endoftext|>y z"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert merge_automaton.arc_labels(PATH)[49407].as_py() == "<|endoftext|>"


def test_query_columns(spark, docs, tmp_path):
    docs(ODD).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(PATH)
    rows = queries.op12_merge_automaton(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD)
    texts = {i: t or "" for i, t in ODD}
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
