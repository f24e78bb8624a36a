"""Byte-level BPE over a corpus by merge replay.

A task takes its documents block by block, cuts them into the matches of the split pattern and keeps
every distinct match once. The merges are then replayed over that whole list of words: an inverted
index leads from a pair of neighbouring tokens to the positions where it stands, the pair of lowest
rank is applied at all its positions, and only the pairs next to a merged position are indexed anew.
Words already encoded stay in a bounded table of the worker, so frequent ones are replayed once.

Matches are independent of each other, so a block gives the same ids as the whole corpus would, and
no token occurrence needs to be shuffled: one pass, memory bound by the block and the table. (A word
list of the corpus joined back to its occurrences would shuffle several times the text itself.)
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import blocks

#: Characters encoded at a time.
BLOCK_CHARS = 3_000_000
#: Encoded words, and chunks of words, kept per Python worker; beyond it a table starts anew.
KEPT_WORDS = 300_000
#: Places of a pair up to which a merge is done one by one; arrays cost more than they save there.
FEW = 12
#: Rows decoded at a time.
DECODED_ROWS = 1_000
#: Longer words are encoded each time they occur in a block instead of being kept.
KEPT_LENGTH = 40

#: Fixed value: the characters that the pattern's ``\s`` stands for (Unicode White_Space).
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """Merges of one vocabulary, applied to lists of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, pair: int) -> int | None:
        return self.ranks.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF])

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of every word (little-endian signed 32-bit): all merges in rank order over all
        words at once. Pairs are ``left << 32 | right``; a place is the position of the left token."""
        text = b"".join(words)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) + np.arange(len(words))
        tokens = np.full(len(text) + len(words) + 1, -1, np.int64)  # -1 after each word
        inside = np.ones(len(tokens), bool)
        inside[ends], inside[-1] = False, False
        tokens[inside] = self.single[np.frombuffer(text, np.uint8)]
        after, before = np.arange(1, len(tokens) + 1), np.arange(-1, len(tokens) - 1)
        index: dict[int, list[np.ndarray | int]] = {}
        queue: list[tuple[int, int]] = []

        def add(places: np.ndarray) -> None:
            left, right = tokens[places], tokens[after[places]]
            whole = (left >= 0) & (right >= 0)
            places, pairs = places[whole], left[whole] << 32 | right[whole]
            if not len(pairs):
                return
            order = np.argsort(pairs, kind="stable")
            places, pairs = places[order], pairs[order]
            cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
            for pair, begin, stop in zip(pairs[[0, *cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(pairs)]):
                if pair in index:
                    index[pair].append(places[begin:stop])
                elif (rank := self.rank(pair)) is not None:
                    index[pair] = [places[begin:stop]]
                    heapq.heappush(queue, (rank, pair))

        def few(pair: int, new: int, places: list[int]) -> None:
            """The same merge and indexing for a handful of places, without array operations."""
            left, right = pair >> 32, pair & 0xFFFFFFFF
            merged = []
            for place in places:
                gone = after[place]
                if tokens[place] == left and tokens[gone] == right:
                    tokens[place], tokens[gone] = new, -2
                    beyond = after[place] = after[gone]
                    before[beyond] = place
                    merged.append(place)
            for place in {p for m in merged for p in (int(before[m]), m)}:
                if place < 0:
                    continue
                first, second = int(tokens[place]), int(tokens[after[place]])
                if first < 0 or second < 0:
                    continue
                both = first << 32 | second
                if both in index:
                    index[both].append(place)
                elif (rank := self.rank(both)) is not None:
                    index[both] = [place]
                    heapq.heappush(queue, (rank, both))

        add(np.flatnonzero(tokens[:-1] >= 0))
        while queue:
            new, pair = heapq.heappop(queue)
            left, right = pair >> 32, pair & 0xFFFFFFFF
            found = index.pop(pair)
            if sum(1 if type(f) is int else len(f) for f in found) <= FEW:
                few(pair, new, sorted({p for f in found for p in ([f] if type(f) is int else f.tolist())}))
                continue
            at = np.sort(np.concatenate([np.atleast_1d(f) for f in found]), kind="stable")
            at = at[np.append(True, at[1:] != at[:-1])]
            at = at[(tokens[at] == left) & (tokens[after[at]] == right)]
            if left == right and len(at) > 1:  # in a run of one token, every second place from its start
                taken, last = [], -1
                for place in at.tolist():
                    if place != last:
                        taken.append(place)
                        last = after[place]
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            tokens[at], tokens[gone] = new, -2
            beyond = after[at] = after[gone]
            before[beyond] = at
            ahead = before[at]
            add(np.concatenate([ahead[ahead >= 0], at]))
        left = np.flatnonzero(tokens >= 0)
        flat, cuts = tokens[left].astype("<i4").tobytes(), np.searchsorted(left, ends).tolist()
        return [flat[4 * i:4 * j] for i, j in zip([0, *cuts], cuts)]


class CorpusEncoder:
    """Ids of texts (little-endian signed 32-bit), by way of the distinct words of a block.

    Where single blanks and line feeds stand between other characters, a match begins at each of them.
    Such texts are cut there, which a plain split does; others are cut by the pattern itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        spaced = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
        self.replay = Replay(ranks)
        self.matches = regex.compile(spaced).findall
        self.strange = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.words: dict[str, bytes] = {}  # by match
        self.chunks: dict[str, bytes] = {}  # by text between cuts

    def _regular(self, text: str) -> bool:
        runs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        return not (runs or text[0] in " \n" or text[-1] in " \n" or self.strange(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        if len(self.chunks) > KEPT_WORDS:
            self.chunks = {}
        words, chunks = self.words, self.chunks
        rows: list[tuple[list[str], list[str]]] = []  # matches, then chunks
        cut: set[str] = set()
        for text in texts:
            if text and self._regular(text):
                head, *rest = text.replace("\n", " \n").split(" ")
                rows.append((self.matches(head), rest))
                cut.update(set(rest).difference(chunks))
            else:
                rows.append((self.matches(text), []))
        # A blank and letters only are one match.
        parts = {c: [f" {c}"] if c.isalpha() else self.matches(c if c[0] == "\n" else f" {c}") for c in cut}
        need: set[str] = set()
        for found in (*parts.values(), *(row[0] for row in rows)):
            need.update(found)
        fresh = list(need.difference(words))
        words.update(zip(fresh, self.replay.encode([w.encode() for w in fresh])))
        chunks.update((c, words[f[0]] if len(f) == 1 else b"".join([words[w] for w in f])) for c, f in parts.items())
        word, chunk = words.__getitem__, chunks.__getitem__
        out = [b"".join([*map(word, found), *map(chunk, rest)]) for found, rest in rows]
        for kept, new in ((words, fresh), (chunks, cut)):
            for key in new:
                if len(key) > KEPT_LENGTH:
                    del kept[key]
        return out


_ENCODERS: dict[tuple[str, str], CorpusEncoder] = {}


def _encoder(path: str, pattern: str) -> CorpusEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = CorpusEncoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text.

    Null and empty texts give no ids; a null id and repeated rows are rows like others; an empty table
    gives an empty one; other columns are not read. Special tokens are ordinary text. ``ranks`` is the
    path of a rank file, ``pattern`` the regular expression whose matches are encoded one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = _encoder(ranks, pattern)
        for batch in batches:
            texts = batch.column(1)
            for begin, stop in blocks(("" if t is None else t for t in texts.to_pylist()), BLOCK_CHARS):
                some = corpus.encode([t or "" for t in texts[begin:stop].to_pylist()])
                ends = np.cumsum([0, *(len(b) // 4 for b in some)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(some), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:stop], pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes that the ids stand for (null for null ids)."""
    kept = [f.name for f in encoded.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: b for b, rank in read_ranks(ranks).items()}.__getitem__
        for whole in batches:
            for begin in range(0, whole.num_rows, DECODED_ROWS):
                batch = whole.slice(begin, DECODED_ROWS)
                ids = batch.column("ids")
                cuts, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
                texts = [
                    b"".join(map(token, flat[i:j].tolist())) if known else None
                    for known, i, j in zip(ids.is_valid().to_pylist(), cuts, cuts[1:])
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*kept, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")
