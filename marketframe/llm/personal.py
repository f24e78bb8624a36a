"""Personal data by weak supervision.

Four kinds have fixed patterns, whose matches are always reported. Beyond them there are candidates:
looser shapes of the same kinds (addresses with a spelled-out at sign, numbers with other separators
or without a country code, card-like numbers that fail the check digit). Labelers look at a candidate
and vote that it is personal, that it is not, or abstain: shapes by pattern, names and domains by
gazetteer, and the words in front of it by context. Nobody labels anything; expectation-maximisation
estimates how reliable each labeler is, and a logistic classifier over features of the span is then
trained on the posterior probabilities. What it accepts joins the reported spans.

Candidates of all documents are counted per pattern of votes and features (a bounded number of
patterns, combined before the shuffle); both fits see the counts of the whole corpus. One scan of the
texts; spans and patterns, not texts, are written in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import materialized

from .weak_labels import fit

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the four kinds.
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_SPELLED = re.compile(r"\b([A-Za-z0-9._%+-]{1,64}) ?(?:\(at\)|\[at\]|\bat\b) ?([A-Za-z0-9-]{1,63}) ?(?:\(dot\)|\[dot\]|\bdot\b) ?([A-Za-z]{2,12})\b")
_NUMBER = re.compile(r"(?<![0-9.+-])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,18}(?![0-9])")

#: Gazetteers and context words, as fixed lists.
_MAIL_WORDS = ("mail", "email", "e-mail", "contact", "write to", "correo", "courriel", "kontakt")
_PHONE_WORDS = ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "whatsapp", "sms")
_CARD_WORDS = ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte")
_OTHER_WORDS = ("isbn", "issn", "version", "order", "invoice", "page", "figure", "table", "id", "no.", "nr.", "doi", "year")
_TOP_LEVEL = frozenset("com org net edu gov io de fr es uk eu info biz ch at it nl".split())
_PROVIDERS = frozenset("gmail yahoo hotmail outlook gmx web icloud proton aol mail".split())


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four kinds, by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_DIGIT = re.compile("[0-9]").search


def _near(words: Sequence[str], before: str) -> bool:
    return any(re.search(rf"(?<!\w){re.escape(w)}", before) for w in words)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """``(kind, start, end, votes, features)`` of looser shapes outside the base spans."""
    taken = sorted((s, e) for _, s, e in base)
    out = []

    def free(start: int, end: int) -> bool:
        return not any(s < end and start < e for s, e in taken)

    if "at" in text and ("dot" in text):
        for m in _SPELLED.finditer(text):
            if free(*m.span()):
                before = text[max(0, m.start() - 40):m.start()].lower()
                bracket = "(" in m.group() or "[" in m.group()
                votes = (
                    1 if bracket else 0,
                    1 if m.group(3).lower() in _TOP_LEVEL else -1,
                    1 if m.group(2).lower() in _PROVIDERS else 0,
                    1 if _near(_MAIL_WORDS, before) else 0,
                    -1 if m.group(1).isalpha() and not bracket and m.group(1).islower() and len(m.group(1)) < 4 else 0,
                )
                features = (1, int(bracket), int(m.group(3).lower() in _TOP_LEVEL), int(m.group(2).lower() in _PROVIDERS), int(any(c.isdigit() for c in m.group(1))), 0, 0)
                out.append(("email", *m.span(), votes, features))
    if _DIGIT(text):
        for m in _NUMBER.finditer(text):
            start, end = m.span()
            if not free(start, end):
                continue
            digits = re.sub("[^0-9]", "", m.group())
            before = text[max(0, start - 40):start].lower()
            groups = [len(g) for g in re.findall("[0-9]+", m.group())]
            card = len(digits) >= 13
            if card:
                votes = (
                    1 if _luhn(digits) else -1,
                    1 if digits[0] in "3456" and len(digits) in (15, 16) else -1,
                    1 if groups in ([4, 4, 4, 4], [4, 6, 5]) else 0,
                    1 if _near(_CARD_WORDS, before) else 0,
                    -1 if _near(_OTHER_WORDS, before) else 0,
                )
            else:
                votes = (
                    1 if len(groups) in (2, 3, 4) and len(digits) in (9, 10, 11) else -1,
                    1 if m.group()[0] in "(0" else 0,
                    1 if groups in ([3, 3, 4], [3, 4, 4], [5, 6], [4, 7]) else 0,
                    1 if _near(_PHONE_WORDS, before) else 0,
                    -1 if _near(_OTHER_WORDS, before) or re.fullmatch(r"(?:19|20)\d\d[-/.]\d\d[-/.]\d\d", m.group()) else 0,
                )
            features = (0, int(len(groups) > 1), min(len(groups), 5), int(m.group()[0] in "(0"), int(votes[0] > 0), int(votes[3] > 0), min(len(digits), 19))
            out.append(("card" if card else "phone", start, end, votes, features))
    return out


_FOUND = "array<struct<kind:string,start:int,end:int>>"
_MAYBE = "array<struct<kind:string,start:int,end:int,pattern:string>>"


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                found = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                more.append([
                    {"kind": k, "start": s, "end": e, "pattern": f"{k};{','.join(map(str, v))};{','.join(map(str, f))}"}
                    for k, s, e, v, f in candidates(text, found)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(more, pa.list_(pa.struct([*span, ("pattern", pa.string())])))],
                ["doc_id", "base", "maybe"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {_FOUND}, maybe {_MAYBE}")


def _design(kind: str, features: Sequence[int]) -> list[float]:
    lengths = [float(features[6] == n) for n in range(7, 20)]
    return [1.0, *(float(kind == k) for k in KINDS), *map(float, features[:6]), *lengths]


def train(counts: dict[str, int], rounds: int = 50, penalty: float = 1.0) -> dict[str, float]:
    """The classifier's probability for every pattern, from the patterns' counts over the corpus."""
    parsed = {}
    for pattern in counts:
        kind, votes, features = pattern.split(";")
        parsed[pattern] = (kind, tuple(map(int, votes.split(","))), tuple(map(int, features.split(","))))
    if not parsed:
        return {}
    soft = {}
    for kind in sorted({p[0] for p in parsed.values()}):  # each kind has its own labelers
        of_kind: dict[tuple, int] = {}
        for pattern, (k, votes, _) in parsed.items():
            if k == kind:
                of_kind[votes] = of_kind.get(votes, 0) + counts[pattern]
        model = fit(of_kind, 5, prior=0.3)
        soft.update({p: model.posterior(v) for p, (k, v, _) in parsed.items() if k == kind})
    names = sorted(parsed)
    x = np.array([_design(parsed[p][0], parsed[p][2]) for p in names])
    y, n = np.array([soft[p] for p in names]), np.array([counts[p] for p in names], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps of the penalised likelihood
        z = np.clip(x @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + penalty * np.eye(len(w)), x.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def find_personal(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: per document the base spans, and those with the accepted candidates,
    by kind, then start; in code points, end exclusive.

    Null and empty texts have none; repeated rows and null ids are rows like others; equal
    probabilities are judged alike; an empty table gives an empty result; other columns are not read.
    """
    found = materialized(_scanned(docs, id_col, text_col), "personal-spans")
    patterns = found.select(F.explode("maybe.pattern").alias("pattern")).groupBy("pattern").count()
    # Patterns combine a few votes and features: some thousands can exist, however large the corpus.
    accepted = sorted(p for p, q in train(dict(map(tuple, patterns.collect()))).items() if q >= threshold)
    listed = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")
    more = F.transform(
        F.filter("maybe", lambda m: F.array_contains(listed, m["pattern"])),
        lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
    )
    ranked = F.transform(
        F.concat("base", more),
        lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"], s["end"], s["kind"]),
    )
    ordered = F.transform(
        F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return found.select("doc_id", "base", ordered.alias("spans"))
