"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word's letter counts are a vector. One replaced letter changes two counts by one, an inserted or left
out one changes a single count, so near words have a squared distance of 2 at equal length and of 1 at
adjacent lengths. Blocks of vectors are multiplied with NumPy, which gives all squared distances of a
block at once; pairs that fit are then verified letter by letter.

*Blocks.* All words of adjacent lengths would be a square of the vocabulary. The letters therefore form
``groups``; an edit touches at most two of them, so near words agree in all counts of some choice of
``groups - 2``. The counts under each choice are a key, words of a key are a block, sorted by length, and
a pair counts under the first choice that it agrees in. The number of groups follows the vocabulary
and sets the cost, not the result. Crowded keys are cut into chunks, and pairs of chunks are spread over
tasks, so that no task holds a whole key.

*Counting.* Tasks count the words of their texts in bounded tables before anything is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import materialized

#: The letters, ASCII ones lower-cased, and their order by frequency in common languages.
_RUN = "a-zÀ-ÿ"
_ORDER = "etaoinsrhldcumfpgwybvkxjqz"
_DIMENSIONS = 26 + 64
#: Words counted in a task's table before it is sent.
TABLE = 300_000
#: Words of one key that a task may hold; more are cut into chunks of half of that.
CROWDED = 4096
#: Rows of a Gram matrix.
TILE = 256
#: Longer words are verified one pair at a time.
WIDE = 64
#: Words up to which four groups of letters serve; each eightfold takes one more.
FOUR_GROUPS = 2_000_000


def word_counts(
    docs: DataFrame, min_length: int = 7, slip: int | None = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(word, n)`` of all letter runs of the texts, A-Z lower-cased, of ``min_length`` letters or more.

    With ``slip``, a run whose crc32 (of ``<id>:<run>``) it divides loses the letter at crc32 modulo
    length: typing errors at a known rate. A null id is an empty text there; null texts hold no word.
    """
    find = re.compile(f"[{_RUN}]{{{min_length},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())], ["word", "n"])
            table.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                own = Counter(find((text.as_py() or "").encode().lower().decode()))
                if not own:
                    continue
                if not slip:
                    table.update(own)
                    continue
                known = doc.as_py()
                before = zlib.crc32(f"{'' if known is None else known}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), before)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    table[word] += n
                if len(table) > TABLE:
                    yield sent()
        yield sent()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(groups: int) -> np.ndarray:
    """The group of each letter; frequent ones are dealt back and forth so that groups weigh alike."""
    group = np.arange(_DIMENSIONS) % groups
    for i, letter in enumerate(_ORDER):
        turn, at = divmod(i, groups)
        group[ord(letter) - 97] = groups - 1 - at if turn % 2 else at
    return group


def number_of_groups(words: int) -> int:
    groups = 4
    while words > FOUR_GROUPS * 8 ** (groups - 4):
        groups += 1
    return groups


def counts(words: list[str]) -> np.ndarray:
    """Letter counts, a row per word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    letter = np.where(points < 128, points - 97, points - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(row * _DIMENSIONS + letter, minlength=len(words) * _DIMENSIONS)
    return flat.reshape(len(words), _DIMENSIONS)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter inserted, left out or replaced leads from ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Signatures:
    """Keys of words under every choice of letter groups."""

    def __init__(self, groups: int):
        self.group = letter_groups(groups)
        self.choices = list(combinations(range(groups), groups - 2))
        self.inside = np.zeros((_DIMENSIONS, groups), np.int64)
        self.inside[np.arange(_DIMENSIONS), self.group] = 1
        # By the set of groups that differ, as bits: the first choice without any of them, else -1.
        self.first = np.array(
            [next((c for c, kept in enumerate(self.choices) if not any(differ >> g & 1 for g in kept)), -1) for differ in range(1 << groups)]
        )
        random = np.random.default_rng(7)
        weights = random.integers(1, 1 << 62, _DIMENSIONS, dtype=np.uint64) | np.uint64(1)
        self.salts = random.integers(1, 1 << 62, len(self.choices), dtype=np.uint64)
        self.weights = np.zeros((_DIMENSIONS, groups), np.uint64)
        self.weights[np.arange(_DIMENSIONS), self.group] = weights

    def keys(self, table: np.ndarray) -> np.ndarray:
        """A row of keys per word, a column per choice."""
        parts = table.astype(np.uint64) @ self.weights
        keys = np.empty((len(table), len(self.choices)), np.int64)
        for c, kept in enumerate(self.choices):
            key = parts[:, kept].sum(1, dtype=np.uint64) + self.salts[c]
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            keys[:, c] = (key ^ (key >> np.uint64(29))).view(np.int64)
        return keys

    def agreed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first choice that each pair of rows agrees in."""
        differ = (np.abs(a - b) @ self.inside) > 0
        return self.first[differ @ (1 << np.arange(differ.shape[1]))]


def _placed(words: DataFrame, groups: int, with_words: bool) -> DataFrame:
    """``(key, choice)`` of every word under every choice, with the word and its number if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(groups)
        each = len(signatures.choices)
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                keys = signatures.keys(counts(batch.column(0).to_pylist()))
                columns = [pa.array(keys.ravel())]
                names = ["key"]
                if with_words:
                    rows = pa.array(np.repeat(np.arange(batch.num_rows), each))
                    choices = np.tile(np.arange(each, dtype=np.int32), batch.num_rows)
                    columns += [pa.array(choices), batch.column(0).take(rows), batch.column(1).take(rows)]
                    names += ["choice", "word", "n"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return words.select("word", "n").mapInArrow(run, "key long, choice int, word string, n long" if with_words else "key long")


def _blocks(words: DataFrame, groups: int, crowded: int) -> DataFrame:
    """``(key, part, choice, side, word, n)``: blocks of bounded size by (key, part). ``side`` is 2 where
    all pairs of a block count, else 0 or 1 where those across do."""
    sizes = _placed(words, groups, False).groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > crowded)
    sizes = materialized(sizes, "spelling-crowded")
    placed = _placed(words, groups, True).join(sizes, "key", "left")
    chunks = F.ceil(F.col("members") / (crowded // 2)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.struct(
            (F.least(other, F.col("own")) * F.col("chunks") + F.greatest(other, F.col("own"))).cast("long").alias("part"),
            F.when(other == F.col("own"), 2).when(F.col("own") < other, 0).otherwise(1).alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(2).alias("side")))
    cut = placed.withColumn("chunks", chunks).withColumn("own", own)
    to = F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(pairs)).alias("to")
    return cut.select("key", "choice", "word", "n", to).select("key", "to.part", "choice", "to.side", "word", "n")


def _letters(words: list[str]) -> np.ndarray:
    """Code points, a row per word, with 0 behind its end; longer words than ``WIDE`` are left out."""
    width = max((len(w) for w in words if len(w) <= WIDE), default=0)
    text = "".join(w.ljust(width, "\0") if len(w) <= WIDE else "\0" * width for w in words)
    return np.frombuffer(text.encode("utf-16-le"), "<u2").reshape(len(words), width)


def _edits_verified(letters: np.ndarray, length: np.ndarray, words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs, of equal or adjacent lengths, are exactly one edit apart."""
    good = np.zeros(len(i), bool)
    wide = np.maximum(length[i], length[j]) > WIDE
    for at in np.flatnonzero(wide).tolist():
        good[at] = one_edit(words[i[at]], words[j[at]])
    same = np.flatnonzero(~wide & (length[i] == length[j]))
    good[same] = (letters[i[same]] != letters[j[same]]).sum(1) == 1
    apart = np.flatnonzero(~wide & (length[i] != length[j]))
    if len(apart):
        swap = length[i[apart]] > length[j[apart]]
        short, long = (letters[np.where(swap, *x)] for x in ((j[apart], i[apart]), (i[apart], j[apart])))
        beyond = np.arange(letters.shape[1] - 1) >= np.minimum(length[i[apart]], length[j[apart]])[:, None]
        ahead = (short[:, :-1] != long[:, :-1]) & ~beyond  # the letter left out lies at the first of these or before
        behind = (short[:, :-1] != long[:, 1:]) & ~beyond  # and after the last of these
        first = np.where(ahead.any(1), ahead.argmax(1), letters.shape[1])
        last = np.where(behind.any(1), letters.shape[1] - 2 - behind[:, ::-1].argmax(1), -1)
        good[apart] = last < first
    return good


def _near_in(batch: pa.RecordBatch, signatures: Signatures) -> tuple[list[int], list[int]]:
    """Row pairs of near words in whole blocks, sorted by key, part and length."""
    words = batch.column("word").to_pylist()
    table, letters = counts(words), _letters(words)
    kind = np.float32 if max(map(len, words)) < 2000 else np.float64  # squares must stay exact
    vectors = table[:, table.any(0)].astype(kind)
    squares = np.einsum("ij,ij->i", vectors, vectors)[:, None]
    ones = np.ones_like(squares)
    left, right = np.hstack([-2 * vectors, squares, ones]), np.hstack([vectors, ones, squares])
    key, part, side, choice = (batch.column(c).to_numpy() for c in ("key", "part", "side", "choice"))
    length = np.array([len(w) for w in words])
    block = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
    found_a, found_b = [], []
    for at in range(0, len(words), TILE):
        stop = min(at + TILE, len(words))
        for to in range(at, len(words), TILE):
            if to > at and block[to] != block[stop - 1]:
                break
            if to > at and length[to] > length[at:stop][block[at:stop] == block[to]].max() + 1:
                break
            distance = left[at:stop] @ right[to:to + TILE].T
            i, j = np.nonzero(distance < 2.5)
            exact = distance[i, j]
            i, j = i + at, j + to
            between = np.abs(length[i] - length[j])
            fits = (i < j) & (block[i] == block[j]) & (between < 2) & (exact == 2 - between)
            fits &= (side[i] == 2) | (side[i] != side[j])
            i, j = i[fits], j[fits]
            fits = _edits_verified(letters, length, words, i, j)
            i, j = i[fits], j[fits]
            fits = signatures.agreed(table[i], table[j]) == choice[i]
            found_a += i[fits].tolist()
            found_b += j[fits].tolist()
    return found_a, found_b


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``(word, other, n_other)``, both ways, for all distinct ``(word, n)`` exactly one edit apart."""
    groups = number_of_groups(words.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(groups)

        def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            batch = table.combine_chunks().to_batches()[0]
            a, b = _near_in(batch, signatures)
            one, two = (pa.array(x + y, pa.int64()) for x, y in ((a, b), (b, a)))
            word, n = batch.column("word"), batch.column("n")
            yield pa.RecordBatch.from_arrays([word.take(one), word.take(two), n.take(two)], ["word", "other", "n_other"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < crowded:
                continue
            key, part = (held.column(c).to_numpy() for c in ("key", "part"))
            last = (key == key[-1]) & (part == part[-1])  # this block may go on in the next batch
            whole = int(np.argmax(last))
            yield from near(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield from near(held)

    blocks = _blocks(words, groups, crowded).repartition("key", "part")
    ordered = blocks.sortWithinPartitions("key", "part", F.char_length("word"))
    return ordered.mapInArrow(run, "word string, other string, n_other long")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` by pointer doubling; forms grow in number at every step, so chains are short."""
    links = materialized(links, "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = materialized(stepped, "spelling-roots")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return links


def variants(
    docs: DataFrame,
    min_length: int = 7,
    min_count: int = 2,
    ratio: int = 10,
    slip: int | None = 31,
    crowded: int = CROWDED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(word, n, form, form_n, n_near, root)`` of every word with ``min_count`` occurrences and more.

    Near words differ by exactly one inserted, left out or replaced letter. ``form`` is the near word of
    most occurrences (of equal ones the first in code-point order) if it has ``ratio`` times as many,
    else null; ``root`` follows forms to the last. ``slip`` is that of ``word_counts``. Null and empty
    texts hold no words, a null id counts as an empty one, repeated rows count each time, an empty
    table gives an empty result, and other columns are not read. Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead to an end")
    counted = word_counts(docs, min_length, slip, id_col, text_col)
    words = materialized(counted.where(F.col("n") >= min_count), "spelling-words")
    near = near_pairs(words, crowded).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("other"))).alias("best")
    )
    best = -F.col("best.less")
    better = best >= ratio * F.col("n")
    judged = materialized(
        words.join(near, "word", "left").select(
            "word", "n", F.when(better, F.col("best.other")).alias("form"), F.when(better, best).alias("form_n"),
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        ),
        "spelling-judged",
    )
    roots = _roots(judged.where("form is not null").select("word", F.col("form").alias("root")))
    return judged.join(roots, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
