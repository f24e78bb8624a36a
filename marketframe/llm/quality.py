"""Quality filter by weak supervision, in Spark expressions only.

Each rule looks at one measure of a text and votes good, bad, or abstains. The rules' reliabilities
are not given: expectation-maximisation estimates them from how often which votes occur together
(``weak_labels``), and a text is kept when its posterior probability of being good reaches a half.
One rule alone need not throw a text out, and several weak signs together can.

Measures are computed inside one row, without exploding words. Counting vote patterns is one
aggregation to at most ``3 ** len(RULES)`` rows; the fit sees only those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import materialized

from . import bitmap
from .weak_labels import VOTES, Reliability, fit

_SPACE = " \t\n\x0b\f\r"
_WINDOW = 8
#: Frequent function words of the four languages, for the rule on running prose.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on with as by be at this from or are an "
    "der die das und in zu den von mit ist des im für auf ein eine nicht sich auch "
    "le la les de des et en un une du que est pour dans qui par sur au pas avec "
    "el los las que y en del se por con para una su al lo como"
).split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures of its texts (``_words`` and ``_windows`` are helper columns)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(
        hashed,
        lambda h: F.when(
            F.size(h) >= _WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(h) - (_WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, _WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE)) != "")

    def without(characters: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, characters, ""))

    with_arrays = docs.withColumn("_words", words).withColumn("_windows", windows).withColumn("_lines", lines)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ"
    return with_arrays.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_windows")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        without(capitals).cast("long").alias("n_capitals"),
        without("!").cast("long").alias("n_shouts"),
        F.size(F.filter("_lines", lambda line: F.substring(F.rtrim(line), -1, 1).isin(*".!?:;\"”»)…")))
        .cast("long").alias("n_closed_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*FUNCTION_WORDS))).cast("long").alias("n_function_words"),
    ).drop("_words", "_windows", "_lines")


def _repeated(windows: Column) -> Column:
    """Words inside windows that occur twice or more. Equal windows stand together once sorted; each
    marked window then adds the words up to the next marked one, eight at most."""

    def marked(sorted_: Column) -> Column:
        def same(i: Column) -> Column:
            return F.coalesce(F.get(sorted_, i)["h"] == F.get(sorted_, i + 1)["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(sorted_, lambda x, i: same(i) | same(i - 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        _let(pairs, lambda s: _let(marked(s), covered))
    )


def _vote(bad: Column, good: Column | None = None) -> Column:
    spoken = F.when(F.col("n_words") == 0, 0).when(bad, -1)
    return (spoken if good is None else spoken.when(good, 1)).otherwise(0).cast("int")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _ordinary() -> Column:
    return (
        (_share("n_symbols", "n_words") < 0.05)
        & _share("word_chars", "n_words").between(3, 9)
        & (_share("n_dup_lines", "n_lines") < 0.1)
        & (_share("n_repeat_words", "n_words") < 0.1)
        & (_share("n_capitals", "word_chars") < 0.15)
        & (_share("n_closed_lines", "n_lines") > 0.5)
    )


#: Rule name to its vote. Thresholds belong to the rules and do not depend on the corpus. A fault that
#: is absent is no sign of quality, so most rules vote bad or abstain.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _vote(_share("n_symbols", "n_words") > 0.15),
    "word_length": lambda: _vote(~_share("word_chars", "n_words").between(2.5, 11)),
    "duplicate_lines": lambda: _vote(_share("n_dup_lines", "n_lines") > 0.3),
    "repeated_words": lambda: _vote(_share("n_repeat_words", "n_words") > 0.2),
    "shouting": lambda: _vote((_share("n_capitals", "word_chars") > 0.3) | (_share("n_shouts", "n_words") > 0.2)),
    "open_lines": lambda: _vote(_share("n_closed_lines", "n_lines") < 0.2),
    "function_words": lambda: _vote(_share("n_function_words", "n_words") < 0.05, _share("n_function_words", "n_words") > 0.12),
    "ordinary": lambda: _vote(F.lit(False), _ordinary()),
    "length": lambda: _vote(F.col("n_words") < 20),
}


def votes(measured: DataFrame) -> DataFrame:
    """``measured`` with a column ``v_<rule>`` per rule."""
    return measured.select("*", *(rule().alias(f"v_{name}") for name, rule in RULES.items()))


def estimate(voted: DataFrame) -> Reliability:
    """Reliabilities of the rules over all rows."""
    names = [f"v_{name}" for name in RULES]
    counted = voted.groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    return fit({tuple(r[:-1]): r[-1] for r in counted}, len(names), prior=0.8)


def posterior(model: Reliability) -> Column:
    """The probability of being good, from the vote columns."""
    terms = [
        F.element_at(F.create_map(*(F.lit(x) for v in VOTES for x in (v, w[v]))), F.col(f"v_{name}"))
        for name, w in zip(RULES, model.weights())
    ]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(model.bias))))


def judge(voted: DataFrame, model: Reliability, threshold: float = 0.5) -> DataFrame:
    """``voted`` with ``base_failed``, ``posterior`` and ``kept``. Texts with fewer than 20 words, or
    with over 30 % of their words in repeated windows, fail whatever the votes."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select("*", failed.alias("base_failed"), posterior(model).alias("posterior")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their columns as they are.

    Null, empty and blank texts fail. Repeated rows are judged alike; equal posteriors need no ties;
    an empty table stays empty. Votes are written once, with the text's hash in place of the text, and
    fit the model. Rows whose hash is surely not among those of rejected texts (a bitmap of fixed size)
    are kept as they are; the others, few where few fail, are measured again, so hashes decide nothing.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(whole, text.alias("_text"), F.xxhash64(text).alias("_h"))
    counted = ["n_words", "n_repeat_words", *(f"v_{name}" for name in RULES)]
    voted = votes(measures(own.select("_h", "_text"), "_text")).select("_h", *counted)
    voted = materialized(voted, "quality-votes")
    model = estimate(voted)
    rejected = judge(voted, model).where("not kept").select("_h")
    marked = bitmap.mark(own, F.col("_h"), bitmap.build(rejected, "_h"), "_perhaps")
    again = votes(measures(marked.where("_perhaps").select("_row", "_text"), "_text"))
    # Below a one-row generator, so that the filter does not evaluate the measures once more.
    judged = judge(again, model).select("_row", F.explode(F.array("kept")).alias("kept"))
    return marked.where("not _perhaps").select("_row.*").unionByName(judged.where("kept").select("_row.*"))
