"""Packing by power-of-two decomposition.

A document becomes token ids plus an end id, and its length is written as a sum of powers of two:
as many pieces of ``max_length`` as fit, then one piece per set bit of what is left, longest first.
Each piece is a sequence of its own, so no sequence crosses documents, equal lengths form the buckets
a trainer draws batches from, and nothing is padded. Documents are independent: no shuffle, and the
memory of a task is one block of text plus a bounded table of encoded words.

Tokenizing is the cost. Words repeat, so each task encodes the words it has not met and looks up the
others. Cutting at blanks is safe for this vocabulary: its normaliser and its splitter treat white
space as a border and drop it.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded words kept per Python worker; beyond it the table starts anew.
KEPT_WORDS = 800_000
#: Words longer than this are encoded each time instead of being kept.
KEPT_LENGTH = 40
#: Characters encoded at a time.
BLOCK_CHARS = 4_000_000

_PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"
#: Characters for which the short way below equals the tokenizer's own: lower case of each stands
#: alone, none composes with a neighbour, and none is white space but the blank.
_PLAIN = r"[\x21-\x7e¡-įı-ɏ]*"
#: Fixed value: the split pattern of the vocabulary's own pre-tokenizer.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TAIL = ".,;:!?%$&*#|"


class WordEncoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit integers; as a dict, of the words met."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(_SPLIT).findall
        self.plain = regex.compile(_PLAIN).fullmatch
        self.merger = tiktoken.Encoding(
            "words", pat_str=r".+", mergeable_ranks=_as_bytes(path), special_tokens={}
        )._core_bpe.encode_single_piece

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not self.plain(word):
            ids = self._whole(word)
        else:
            body = word.rstrip(_TAIL)
            if body and body != word and body[-1].isalnum():
                ids = self[body] + self[word[len(body):]]
            elif word.isalpha():
                ids = array("I", self.merger(word.lower().encode() + b"\xff")).tobytes()
            else:
                merged = array("I")
                for part in self.split(word.lower()):
                    merged.extend(self.merger(part.encode() + b"\xff"))
                ids = merged.tobytes()
        if len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # may hold a special token, which the tokenizer takes before all else
            return self._whole(text)
        if len(self) > KEPT_WORDS:
            self.clear()
        low = text if "Σ" in text or "İ" in text else text.lower()
        return b"".join(map(self.__getitem__, low.replace("\n", " ").split(" ")))


def _as_bytes(path: str) -> dict[bytes, int]:
    """The vocabulary as byte strings, a word's end as the byte 255 (which UTF-8 never holds).

    Ids follow the order of merges, with single bytes first, so they serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {}
    for token, i in vocabulary.items():
        body, end = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
        if all(c in byte for c in body) and not token.startswith("<|"):
            ranks[bytes(byte[c] for c in body) + end] = i
    return ranks


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def blocks(texts: Iterable, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters (a longer text is a range of its own)."""
    begin = size = at = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield begin, at
            begin, size = at, 0
        size += len(text) + 1
    if size:
        yield begin, at + 1


def piece_lengths(tokens: int, max_length: int) -> list[int]:
    """``tokens`` as a sum of powers of two, none above ``max_length``, longest first."""
    whole, rest = divmod(tokens, max_length)
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [max_length] * whole + bits


def decompose(
    docs: DataFrame,
    tokenizer: str,
    max_length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset)`` of all documents.

    ``ids`` are little-endian unsigned 32-bit integers, ``bucket`` is log2 of the length and the key to
    write by, ``sequence_id`` is unique in one result. A null or empty text is the end id alone; a null
    id and repeated rows give pieces like any others; an empty table gives none; other columns are not
    read. ``max_length`` must be a power of two, else ``ValueError``.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for begin, stop in blocks(("" if t is None else t for t in texts.to_pylist())):
                some = [t or "" for t in texts[begin:stop].to_pylist()]
                out: list[tuple] = []
                for doc, ids in zip(batch.column(0)[begin:stop].to_pylist(), map(words.encode, some)):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, max_length):
                        part = ids[4 * start:4 * (start + length)]
                        out.append((doc, start, length, n, length.bit_length() - 1, part))
                        start += length
                names = ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, _PIECES).select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as one Parquet folder per length (``bucket=11`` holds pieces of 2048)."""
    pieces.write.partitionBy("bucket").parquet(path)
