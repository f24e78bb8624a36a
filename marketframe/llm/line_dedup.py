"""Line deduplication over a corpus by a deletion-neighbourhood join.

Lines are compared as sequences of words (lower case, cut at ASCII white space). Equal lines with a word
are one key, however short. Beyond that, lines of at least ``near_words`` words count as the same when one
word replaced, inserted or left out leads from one to the other; lines of fewer words, which also are those
of scripts that write no blanks, when one character does, if they have ``near_chars`` characters. The line
that comes first (smallest document id, then line number) stays, every later one goes.

*Deletion neighbourhood.* Of two lines one edit apart, both give the same words (or characters) once the
edited one is left out (or one gives the other). So each line sends out a hashed key per left-out word. A
key of a replacement also names the place, which makes all its lines partners of each other, and a key of an
insertion has one full line, the partner of all others. A group therefore needs its first line only,
never its pairs. Partners are verified on their words.

*Few lines send keys.* One edit leaves the first or the second half of a line whole. Lines whose
halves (for both possible lengths) occur nowhere else have no partner; this exact filter works on four
hashes per line. Texts of the others are fetched by a second scan behind a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import Scratch

from . import bitmap

_SPACE = r"[\x20\x09-\x0D]+"
_HALVES = [f"half{i}" for i in range(4)]
#: Odd multipliers for hashing, and the inverse of the first modulo 2**64.
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))

#: Places are decimals: document id, nine digits of its text's hash, ten digits of the line number.
_LINE, _TEXT = 10**10, 10**19
#: Seeds of halves of characters begin here, those of words below.
_BY_CHARACTER = 1 << 40


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, text, _base)``: the other columns in one struct, so that their names meet none of these, and
    the place of each row's first line (equal for repeated rows)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.lit(None)
    known = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    whole = F.col(f"`{text_col}`").cast("string")
    text = F.pmod(F.xxhash64(whole), F.lit(10**9))
    place = known.cast("decimal(19,0)") * F.expr(f"{_TEXT}BD") + text.cast("decimal(9,0)") * F.expr(f"{_LINE}BD")
    return docs.select(row.alias("row"), whole.alias("text"), place.cast("decimal(38,0)").alias("_base"))


def _tokens(line: Column, near_words: int) -> Column:
    """A line's words, or its characters between two marks (which keep them apart from words) where the words
    are few."""
    words = F.split(F.lower(F.btrim(line, F.lit(" \t\n\x0b\f\r"))), _SPACE)
    mark = F.array(F.lit("\0"))
    return F.transform(
        F.array(words), lambda w: F.when(F.size(w) >= near_words, w).otherwise(F.concat(mark, F.split(F.array_join(w, " "), ""), mark))
    )[0]


def _lines(keyed: DataFrame) -> DataFrame:
    lines = keyed.select("_base", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.select("_base", "no", (F.col("_base") + F.col("no")).cast("decimal(38,0)").alias("place"), "line")


def _occurrences(keyed: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """``(place, h1, h2, half0 .. half3)`` of every line with a word; the halves, of its words or else its
    characters, are null where it is too short for an edit. Lines leave a task in runs of bounded length,
    whatever the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        whole, part = xxhash.xxh3_128_digest, xxhash.xxh3_64_digest
        for batch in batches:
            rows: list[int] = []
            numbers: list[int] = []
            hashes: list[bytes] = []
            short: list[bool] = []

            def table() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 6)
                halves = [pa.array(h[:, i], mask=np.array(short)) for i in range(2, 6)]
                columns = [batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), *halves]
                return pa.RecordBatch.from_arrays(columns, ["_base", "no", "h1", "h2", "half0", "half1", "half2", "half3"])

            for row, text in enumerate(batch.column(1)):
                for no, line in enumerate((text.as_py() or "").lower().encode().split(b"\n")):
                    if len(rows) >= 50_000:
                        yield table()
                        rows, numbers, hashes, short = [], [], [], []
                    w = line.split()  # bytes are cut at ASCII white space
                    n = len(w)
                    if not n:
                        continue
                    joined = b" ".join(w)
                    rows.append(row)
                    numbers.append(no)
                    hashes.append(whole(joined))
                    if n >= near_words:
                        short.append(False)
                        for length in (n, n - 1):
                            first = length // 2
                            hashes.append(part(b" ".join(w[:first]), 2 * length))
                            hashes.append(part(b" ".join(w[n - length + first:]), 2 * length + 1))
                        continue
                    characters = joined.decode() if len(joined) >= near_chars else ""
                    n = len(characters)
                    short.append(n < near_chars)
                    if n < near_chars:
                        hashes.append(bytes(32))
                        continue
                    for length in (n, n - 1):
                        first = length // 2
                        hashes.append(part(characters[:first].encode(), _BY_CHARACTER + 2 * length))
                        hashes.append(part(characters[n - length + first:].encode(), _BY_CHARACTER + 2 * length + 1))
            if rows:
                yield table()

    kinds = ", ".join(["_base decimal(38,0)", "no int", *(f"{c} long" for c in ("h1", "h2", *_HALVES))])
    lines = keyed.select("_base", "text").mapInArrow(run, kinds)
    return lines.select((F.col("_base") + F.col("no")).cast("decimal(38,0)").alias("place"), "h1", "h2", *_HALVES)


def _mixed(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """One hash of several columns of unsigned 64-bit numbers."""
    for b in more:
        a = (a ^ (b * _ODD)) * _MIX
        a ^= a >> np.uint64(29)
    return (a * _ODD).view(np.int64)


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """``(key, role, place)``: ``S`` a word replaced at a place, ``Y`` a word left out, ``X`` the whole
    line. A line's hash is the sum of its words' hashes times powers of an odd number (modulo 2**64);
    running sums give the hash without each word, for all lines of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            words = batch.column(1)
            sizes = np.diff(words.offsets.to_numpy())
            h = np.array([digest(w) for w in words.flatten().to_pylist()], np.uint64)
            starts = np.cumsum(sizes) - sizes
            line = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(h)) - starts[line]
            powers = np.cumprod(np.full(int(sizes.max(initial=0)), _ODD, np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[at], dtype=np.uint64)])
            begin, total = sums[starts], sums[starts + sizes] - sums[starts]
            before, after = sums[:-1] - begin[line], total[line] - (sums[1:] - begin[line])
            rest, n = before + after * _INVERSE, sizes.astype(np.uint64)
            again = np.zeros(len(h), bool)  # leaving out a word or its equal neighbour is the same
            again[1:] = (h[1:] == h[:-1]) & (at[1:] > 0)
            keys = [_mixed(total, n), _mixed(rest, n[line] - np.uint64(1), at.astype(np.uint64) + np.uint64(1)), _mixed(rest, n[line] - np.uint64(1))[~again]]
            places = [np.arange(len(sizes)), line, line[~again]]
            for role, some, whose in zip("XSY", keys, places):
                for i in range(0, len(some), 100_000):
                    own = pa.array(whose[i:i + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some[i:i + 100_000]), pa.array([role] * len(own), pa.string()), batch.column(0).take(own)],
                        ["key", "role", "place"],
                    )

    return lines.select("place", "w").mapInArrow(run, "key long, role string, place decimal(38,0)")


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word replaced, inserted or left out, or nothing, leads from ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column("w"), batch.column("v"))]
            yield pa.RecordBatch.from_arrays([batch.column("place").filter(pa.array(good, pa.bool_()))], ["place"])

    return pairs.select("place", "w", "v").mapInArrow(run, "place decimal(38,0)")


def _near(keys: DataFrame, keyed: DataFrame, near_words: int, scratch: Scratch) -> DataFrame:
    """Places of first lines that have an earlier partner one edit away."""
    halves = keys.where(F.col("halves").isNotNull()).select("first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi")
    places = scratch.table(halves.join(shared.select("half"), "half").select(F.col("first").alias("place")).distinct(), "lines-shared")
    base = F.col("place") - F.col("place") % F.expr(f"{_LINE}BD")
    held = bitmap.build(places.select(F.xxhash64(base.cast("decimal(38,0)")).alias("h")), "h")
    perhaps = bitmap.mark(keyed.select("_base", "text"), F.xxhash64("_base"), held, "_perhaps").where("_perhaps")
    lines = _lines(perhaps).join(places, "place").select("place", _tokens(F.col("line"), near_words).alias("w"))
    lines = scratch.table(lines.dropDuplicates(["place"]), "lines-texts")
    sent = scratch.table(_neighbourhood(lines), "lines-keys")
    whole = F.col("role") == "X"
    met = sent.groupBy("key").agg(
        F.min(F.when(whole, F.col("place"))).alias("full"), F.min(F.when(~whole, F.col("place"))).alias("other"), F.count("*").alias("n")
    ).where("n > 1")
    partner = F.when(F.col("role") == "Y", F.col("full")).otherwise(F.col("other"))
    pairs = sent.join(met, "key").select("place", partner.alias("partner")).where("partner < place").distinct()
    texts = lines.select(F.col("place").alias("partner"), F.col("w").alias("v"))
    return _verified(pairs.join(lines, "place").join(texts, "partner")).distinct()


def dedup_lines(
    docs: DataFrame,
    near_words: int = 10,
    near_chars: int = 20,
    max_edits: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the text left after line deduplication, and ``n_lines``, ``n_removed`` (long).

    All rows and other columns stay, whatever their names (only ``n_lines`` and ``n_removed`` are
    replaced). A null text stays null with 0 lines; lines without a word, such as that of an empty text,
    never go. A text whose lines all go becomes empty. Repeated rows (same id, same text) count as one and
    come out alike; rows that share an id only are ordered by their text's hash; rows without an id
    come last. ``max_edits`` is 1 or 0. Intermediate tables are removed, but for the one the result reads.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs.select(*(F.col(f"`{c}`") for c in names)), id_col, text_col)
    seen = scratch.table(_occurrences(keyed, near_words, near_chars), "lines-seen")
    keys = scratch.table(
        seen.groupBy("h1", "h2").agg(
            F.min("place").alias("first"), F.count("*").alias("n"),
            *(F.min(half).alias(half) for half in _HALVES),
        ).select("h1", "h2", "first", "n", F.when(F.col("half0").isNotNull(), F.array(*_HALVES)).alias("halves")),
        "lines-distinct",
    )
    if max_edits:
        near = _near(keys, keyed, near_words, scratch).select(F.col("place").alias("first"), F.lit(True).alias("near"))
        judged = keys.select("h1", "h2", "first", "n").join(near, "first", "left")
    else:
        judged = keys.select("h1", "h2", "first", "n", F.lit(None).cast("boolean").alias("near"))
    judged = judged.where("n > 1 or near is not null").select("h1", "h2", "first", "near")
    gone = seen.select("h1", "h2", "place").join(judged, ["h1", "h2"]).where("near is not null or place > first")
    no = F.col("place") % F.expr(f"{_LINE}BD")
    removed = scratch.table(
        gone.select((F.col("place") - no).cast("decimal(38,0)").alias("_base"), no.cast("int").alias("no"))
        .groupBy("_base")
        .agg(F.collect_set("no").alias("_gone")),
        "lines-removed",
    )
    scratch.drop_all_but(removed)
    scratch.sweep()
    marked = bitmap.mark(keyed, F.xxhash64("_base"), bitmap.build(removed.select(F.xxhash64("_base").alias("h")), "h"), "_perhaps")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    untouched = marked.where("not _perhaps").withColumn("_gone", F.lit(None).cast("array<int>"))
    touched = marked.where("_perhaps").join(removed, "_base", "left").select(*untouched.columns)
    rest = F.when(
        F.col("_gone").isNull(), F.col("text")
    ).otherwise(F.array_join(F.transform(kept, lambda i: F.col("_lines")[i]), "\n"))
    columns = [F.col("row").getField(c).alias(c) if c != text_col else rest.alias(c) for c in names]
    both = [
        part.withColumn("_lines", lines).select(
            *columns,
            F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        )
        for part in (untouched, touched)
    ]
    return both[0].unionByName(both[1])
