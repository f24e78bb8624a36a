"""Validation of registry entries and company records, with one row per error.

Records are checked as VARIANT, because absent, null and wrongly typed must be told apart and a
typed read loses the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical_ticker, kind_of, lax_integer_of
from ..functions.variants import elements, entries, is_blank, member, member_kinds, string_of
from ..schemas import COMPANY_SCHEMA, LIST_FIELDS, MAP_FIELDS, MAPPING_SCHEMA

ERROR_COLUMNS = ("source", "ticker", "position", "error")

# Fixed value: what a ticker may look like under the business rules.
TICKER_PATTERN = r"^[A-Z][A-Z0-9.\-]{0,9}$"
# How the messages on repeats and on absent files begin.
DUPLICATE_ID = "Duplicate id detected: "
DUPLICATE_TICKER = "Duplicate ticker detected: "
NO_FILE = "JSON file not found for ticker "
# How the kind of a JSON root is named in an error.
ROOT_NAMES = {
    "string": "str",
    "integer": "int",
    "number": "float",
    "boolean": "bool",
    "null": "NoneType",
}


def _problem(field: str, bad: Column, text: str) -> Column:
    return F.when(bad, F.lit(f"{field}: {text}"))


def _kind(kinds: Column, field: str) -> Column:
    return F.try_element_at(kinds, F.lit(field))


def _required_string(kinds: Column, field: str) -> Column:
    kind = _kind(kinds, field)
    return F.when(kind.isNull(), F.lit(f"{field}: field required")).when(
        kind != "string", F.lit(f"{field}: not a valid string")
    )


def _required_integer(record: Column, kinds: Column, field: str = "id") -> Column:
    value = lax_integer_of(member(record, field))
    return F.when(_kind(kinds, field).isNull(), F.lit(f"{field}: field required")).when(
        value.isNull(), F.lit(f"{field}: not a valid integer")
    )


# Optional field groups, the kinds they accept, and the message for the others.
_OPTIONAL = (
    (("sector", "industry", "description"), ("string", "null"), "not a valid string"),
    (tuple(LIST_FIELDS), ("strings",), "not a list of strings"),
    (tuple(MAP_FIELDS), ("object",), "not a valid object"),
)


def collection_problems(record: Column, kinds: Column, blank_ok: bool = False) -> list[Column]:
    """Messages for the optional fields. ``blank_ok`` lets null and other blank values stand for an
    empty collection, as normalisation does."""
    found = []
    for fields, accepted, text in _OPTIONAL:
        for field in fields:
            bad = ~_kind(kinds, field).isin(*accepted)
            message = F.lit(f"{field}: {text}")
            if blank_ok and "string" not in accepted:
                message = F.when(~is_blank(member(record, field)), message)
            found.append(F.when(bad, message))
    return found


def messages(*problems: Column) -> Column:
    """The messages that apply, as an array."""
    return F.array_compact(F.array(*problems))


def record_messages(record: Column, kinds: Column) -> Column:
    """All field messages of a company record; empty for a valid one. ``kinds`` is null when the
    record is not an object."""
    fields = messages(
        _required_integer(record, kinds),
        _required_string(kinds, "name"),
        _required_string(kinds, "ticker"),
        *collection_problems(record, kinds),
    )
    return F.when(kinds.isNull(), F.array(F.lit("record: not a valid object"))).otherwise(fields)


def document_records(documents: DataFrame, body: str = "body") -> DataFrame:
    """Whole documents to records ``(…, record_index, record, file_error)``.

    An array gives one row per element, an object one row; anything else, or text that is not JSON,
    gives one row with ``file_error``. The other columns pass through.
    """
    others = [c for c in documents.columns if c != body]
    root = F.col("root")
    names = F.create_map(*[F.lit(x) for pair in ROOT_NAMES.items() for x in pair])
    file_error = F.when(root.isNull(), F.lit("Invalid JSON")).otherwise(
        F.concat(
            F.lit("Invalid JSON structure: expected array or object, got "),
            F.try_element_at(names, kind_of(root)),
        )
    )

    def item(record: Column, error: Column) -> Column:
        return F.struct(record.alias("record"), error.alias("file_error"))

    no_error, no_record = F.lit(None).cast("string"), F.lit(None).cast("variant")
    items = F.coalesce(
        F.transform(elements(root), lambda e: item(e, no_error)),
        F.when(entries(root).isNotNull(), F.array(item(root, no_error))),
        F.array(item(no_record, file_error)),
    )
    # An outer generator: no filter is inferred for it or moves below it, so JSON is parsed once.
    return (
        documents.withColumn("root", F.try_parse_json(body))
        .select(*others, F.posexplode_outer(items).alias("index", "item"))
        .where(F.col("item").isNotNull())
        .select(*others, (F.col("index") + 1).cast("bigint").alias("record_index"), "item.*")
    )


def computed_once(df: DataFrame, column: str) -> DataFrame:
    """Keep later filters on an expensive column above this point. Spark would otherwise move them
    below the projection and evaluate the column again there; it does not move them below a
    generator, and this one emits exactly one row per row."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode_outer(F.array(column)).alias(column))


def checked_records(records: DataFrame) -> DataFrame:
    """Add ``problems`` to records, and drop the record itself."""
    found = record_messages(F.col("record"), F.col("kinds"))
    checked = (
        records.withColumn("kinds", member_kinds(F.col("record"), COMPANY_SCHEMA.names))
        .withColumn("problems", F.when(F.col("file_error").isNull(), found))
        .drop("record", "kinds")
    )
    return computed_once(checked, "problems")


def record_errors(checked: DataFrame) -> DataFrame:
    """One row per bad record or bad document, with all messages of a record in one text."""
    others = [c for c in checked.columns if c not in ("problems", "file_error")]
    listed = F.concat(
        F.lit("Record "), F.col("record_index"), F.lit(": "), F.array_join("problems", "; ")
    )
    return checked.where(F.col("file_error").isNotNull() | (F.size("problems") > 0)).select(
        *others, F.coalesce("file_error", listed).alias("error")
    )


def field_errors(checked: DataFrame) -> DataFrame:
    """One row per offending field."""
    others = [c for c in checked.columns if c not in ("problems", "file_error")]
    found = checked.select(*others, F.explode_outer("problems").alias("error"))
    return found.where(F.col("error").isNotNull())


def valid_count(checked: DataFrame) -> DataFrame:
    """One row: number of valid records and number of errors."""
    bad = F.col("file_error").isNotNull() | (F.size("problems") > 0)
    return checked.agg(
        F.count_if(~bad).alias("valid_records"), F.count_if(bad).alias("record_errors")
    )


def with_ticker_prefix(errors: DataFrame) -> DataFrame:
    """Errors of many tickers in one list: ``TICKER: message``."""
    return errors.withColumn("error", F.concat("ticker", F.lit(": "), "error"))


def missing_datasets(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """An error for each explicitly requested ticker without a document."""
    absent = requested.select("ticker").distinct().join(
        existing.select("ticker").distinct(), "ticker", "left_anti"
    )
    return absent.select(
        "ticker",
        F.concat(F.lit(NO_FILE), F.col("ticker")).alias("error"),
    )


def checked_entries(entries_: DataFrame) -> DataFrame:
    """Add ``problems`` to raw registry entries ``(pos, entry)``."""
    entry, kinds = F.col("entry"), F.col("kinds")
    fields = messages(
        _required_integer(entry, kinds),
        _required_string(kinds, "name"),
        _required_string(kinds, "ticker"),
    )
    found = F.when(kinds.isNull(), F.array(F.lit("entry: not a valid object"))).otherwise(fields)
    checked = (
        entries_.withColumn("kinds", member_kinds(entry, MAPPING_SCHEMA.names))
        .withColumn("problems", found)
        .drop("kinds")
    )
    return computed_once(checked, "problems")


def repeats(rows: DataFrame, key: str) -> DataFrame:
    """Every row that repeats the key of a row before it, by ``pos``; of rows of one key at one position
    (registries of several files), all but one. Null is a key like others.

    Firsts are found by an aggregation that combines on the map side, and taken away by key and
    position. No task ever gathers the rows of one key, however often it repeats.
    """
    firsts = rows.groupBy(key).agg(F.min("pos").alias("first")).withColumnRenamed(key, "_key")
    at_first = F.col(key).eqNullSafe(F.col("_key")) & (F.col("pos") == F.col("first"))
    later = rows.join(firsts, at_first, "left_anti")
    counted = rows.groupBy(key, "pos").agg(F.count("*").alias("_n")).where("_n > 1")
    beside = counted.join(firsts, at_first, "left_semi")
    copies = beside.select(*rows.columns, F.explode(F.sequence(F.lit(2).cast("long"), "_n")).alias("_copy"))
    return later.unionByName(copies.drop("_copy"))


def duplicate_ids(mapping: DataFrame) -> DataFrame:
    found = repeats(mapping.select("pos", "id"), "id")
    shown = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    return found.select("pos", F.concat(F.lit(DUPLICATE_ID), shown).alias("error"))


def duplicate_tickers(mapping: DataFrame) -> DataFrame:
    rows = mapping.select("pos", canonical_ticker(F.col("ticker")).alias("ticker"))
    found = repeats(rows, "ticker")
    shown = F.coalesce("ticker", F.lit("null"))
    return found.select("pos", F.concat(F.lit(DUPLICATE_TICKER), shown).alias("error"))


def mapping_errors(entries_: DataFrame) -> DataFrame:
    """Errors of a registry ``(pos, entry)``. One invalid entry voids the whole file: then its
    message is the only error and duplicates are not looked for."""
    invalid = checked_entries(entries_).where(F.size("problems") > 0)
    verdict = invalid.agg(
        F.min_by(F.struct("pos", F.array_join("problems", "; ").alias("error")), "pos").alias("e")
    ).where(F.col("e").isNotNull())
    schema_error = verdict.select("e.pos", "e.error")
    typed = entries_.select(
        "pos",
        lax_integer_of(member(F.col("entry"), "id")).alias("id"),
        string_of(member(F.col("entry"), "ticker")).alias("ticker"),
    )
    broken = invalid.select(F.count("*")).scalar()
    doubles = duplicate_ids(typed).unionByName(duplicate_tickers(typed))
    return schema_error.unionByName(doubles.where(broken == 0))


def mapping_count(entries_: DataFrame) -> DataFrame:
    """One row: entries of a valid registry, or 0 when any entry is invalid."""
    bad = F.size("problems") > 0
    return checked_entries(entries_).agg(
        F.when(F.count_if(bad) > 0, 0).otherwise(F.count("*")).cast("bigint").alias(
            "mapping_entries"
        )
    )


def error_report(**parts: DataFrame) -> DataFrame:
    """One error list out of several, each part under its own name in ``source``."""
    report = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("source"), "error")
        report = rows if report is None else report.unionByName(rows)
    return report


def orphan_keys(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str
) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks, with the number of rows that carry them. The child is
    reduced to distinct keys before the join, so a hot key is one row there."""
    keys = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key"))
        .agg(F.count("*").alias("row_count"))
    )
    known = parent.select(F.col(parent_key).alias("key")).distinct()
    return keys.join(known, "key", "left_anti").select(
        F.lit(relation).alias("relation"), F.col("key").cast("string").alias("key"), "row_count"
    )


def reference_errors(prices: DataFrame, companies: DataFrame, mapping: DataFrame) -> DataFrame:
    """Price points without a company, and companies without a registry entry."""
    return orphan_keys(prices, "company_id", companies, "id", "price->company").unionByName(
        orphan_keys(companies, "id", mapping, "id", "company->mapping")
    )


def business_errors(records: DataFrame, pattern: str = TICKER_PATTERN) -> DataFrame:
    """Required texts that are empty and tickers of an unusual form, one row per finding. Columns
    other than ``name`` and ``ticker`` pass through."""

    def empty(field: str) -> Column:
        return F.coalesce(F.col(field).rlike(r"^\s*$"), F.lit(True))

    found = messages(
        _problem("name", empty("name"), "must not be empty"),
        _problem("ticker", empty("ticker"), "must not be empty"),
        _problem("ticker", ~empty("ticker") & ~F.col("ticker").rlike(pattern), "unusual format"),
    )
    return records.select(
        *[c for c in records.columns if c != "name"], F.explode(found).alias("error")
    )


def validation_totals(
    entries_: DataFrame, checked: DataFrame, map_errors: DataFrame
) -> DataFrame:
    """One row: registry entries, valid records, errors of either kind."""
    totals = [
        mapping_count(entries_).select(
            F.lit("mapping_entries").alias("item"), F.col("mapping_entries").alias("n")
        ),
        valid_count(checked).select(
            F.explode(
                F.create_map(
                    F.lit("valid_records"),
                    F.col("valid_records"),
                    F.lit("record_errors"),
                    F.col("record_errors"),
                )
            ).alias("item", "n")
        ),
        map_errors.agg(F.count("*").alias("n")).select(F.lit("mapping_errors").alias("item"), "n"),
    ]
    rows = totals[0].unionByName(totals[1]).unionByName(totals[2])
    return rows.select("item", F.col("n").cast("bigint").alias("n"))
