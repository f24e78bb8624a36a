from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marketframe.operators import validation
from marketframe.sources import document_lines, read_document_text

from .conftest import NOVA, QRTZ


def records(spark, *bodies):
    rows = [(i, b) for i, b in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "doc int, body string")
    return validation.checked_records(validation.document_records(docs))


def problems(spark, record) -> list[str]:
    row = records(spark, json.dumps(record)).head()
    return [row.file_error] if row.file_error else row.problems


BASE = {"id": 1, "name": "n", "ticker": "T"}


def test_samples_are_valid(spark, write, sample_lines):
    lines = validation.document_records(document_lines(spark, sample_lines))
    count = validation.valid_count(validation.checked_records(lines)).head()
    assert tuple(count) == (2, 0)
    whole = read_document_text(spark, write("c.json", f"[{NOVA},\n{QRTZ}]"))
    count = validation.valid_count(validation.checked_records(validation.document_records(whole)))
    assert tuple(count.head()) == (2, 0)


@pytest.mark.parametrize("value", [1, "1", " 7 ", "1.0", 1.0, "+3", "1_000", True])
def test_id_accepted(spark, value):
    assert problems(spark, BASE | {"id": value}) == []


@pytest.mark.parametrize("value", ["1.5", 1.5, "x", None, {}, [1]])
def test_id_rejected(spark, value):
    assert problems(spark, BASE | {"id": value}) == ["id: not a valid integer"]


def test_required_fields(spark):
    assert problems(spark, {}) == ["id: field required", "name: field required", "ticker: field required"]
    assert problems(spark, BASE | {"name": 5, "ticker": None}) == [
        "name: not a valid string",
        "ticker: not a valid string",
    ]
    assert problems(spark, BASE | {"name": ""}) == []


@pytest.mark.parametrize(
    "field, good, bad, text",
    [
        ("sector", ["s", None], [5, []], "not a valid string"),
        ("description", ["é", None], [True, {}], "not a valid string"),
        ("indices", [[], ["a", "b"]], [None, [1], "SP500", ["a", None], {}], "not a list of strings"),
        ("exchanges", [["x"]], [None, 0], "not a list of strings"),
        ("aggregations", [{}, {"a": [1]}], [None, [], "x", 3], "not a valid object"),
        ("insights", [{}, {"stock_price": 5}], [None, []], "not a valid object"),
        ("lastUpdated", [{"x": None}], [None, "2024"], "not a valid object"),
    ],
)
def test_optional_fields(spark, field, good, bad, text):
    for value in good:
        assert problems(spark, BASE | {field: value}) == [], value
    for value in bad:
        assert problems(spark, BASE | {field: value}) == [f"{field}: {text}"], value


def test_unknown_keys_are_ignored(spark):
    assert problems(spark, BASE | {"extra": [1, None]}) == []


def test_array_with_non_objects(spark):
    checked = records(spark, f"[{NOVA}, 3, null]")
    errors = validation.record_errors(checked).orderBy("record_index").collect()
    assert [e.error for e in errors] == [
        "Record 2: record: not a valid object",
        "Record 3: record: not a valid object",
    ]
    assert tuple(validation.valid_count(checked).head()) == (1, 2)


@pytest.mark.parametrize(
    "body, error",
    [
        ("{broken", "Invalid JSON"),
        ("", "Invalid JSON"),
        ('"x"', "Invalid JSON structure: expected array or object, got str"),
        ("5", "Invalid JSON structure: expected array or object, got int"),
        ("1.5", "Invalid JSON structure: expected array or object, got float"),
        ("true", "Invalid JSON structure: expected array or object, got bool"),
        ("null", "Invalid JSON structure: expected array or object, got NoneType"),
    ],
)
def test_file_errors(spark, body, error):
    assert [r.error for r in validation.record_errors(records(spark, body)).collect()] == [error]


def test_empty_array_has_no_records(spark):
    assert records(spark, "[]").count() == 0


def entries(spark, *values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, text string").select(
        "pos", F.try_parse_json("text").alias("entry")
    )


def entry(ident, ticker):
    return {"id": ident, "name": "n", "ticker": ticker}


def test_duplicates(spark):
    table = entries(spark, entry(1, "AAPL"), entry("1", " aapl "), entry(2, "Aapl"), entry(3, "X"))
    errors = validation.mapping_errors(table).orderBy("pos", "error").collect()
    assert [(e.pos, e.error) for e in errors] == [
        (1, "Duplicate id detected: 1"),
        (1, "Duplicate ticker detected: AAPL"),
        (2, "Duplicate ticker detected: AAPL"),
    ]
    assert validation.mapping_count(table).head()[0] == 4


def test_one_bad_entry_voids_the_mapping(spark):
    table = entries(spark, entry(1, "A"), entry(1, "A"), entry("x", "B"), 7)
    errors = validation.mapping_errors(table).collect()
    assert [(e.pos, e.error) for e in errors] == [(2, "id: not a valid integer")]
    assert validation.mapping_count(table).head()[0] == 0


def test_a_valid_mapping_has_no_errors(spark):
    table = entries(spark, entry(1, "A"), entry(2, "B"))
    assert validation.mapping_errors(table).count() == 0


def test_duplicates_never_gather_a_key(spark):
    rows = spark.range(100).selectExpr("id as pos", "id % 2 as id")
    plan = validation.duplicate_ids(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert validation.duplicate_ids(rows).count() == 98


def test_business_rules(spark):
    rows = [("", "AAPL"), ("n", ""), ("n", None), ("n", "aapl"), ("n", "BRK.B"), ("n", "TOOLONGTICKER")]
    df = spark.createDataFrame(rows, "name string, ticker string")
    found = sorted((str(r.ticker), r.error) for r in validation.business_errors(df).collect())
    assert found == [
        ("", "ticker: must not be empty"),
        ("AAPL", "name: must not be empty"),
        ("None", "ticker: must not be empty"),
        ("TOOLONGTICKER", "ticker: unusual format"),
        ("aapl", "ticker: unusual format"),
    ]


def test_references(spark):
    prices = spark.createDataFrame([(1,), (1,), (9,), (9,), (9,), (None,)], "company_id long")
    companies = spark.createDataFrame([(1,), (2,)], "id long")
    mapping = spark.createDataFrame([(1,)], "id long")
    found = {tuple(r) for r in validation.reference_errors(prices, companies, mapping).collect()}
    assert found == {("price->company", "9", 3), ("company->mapping", "2", 1)}


def test_missing_and_report(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "ticker string")
    missing = validation.missing_datasets(names("A", "B"), names("A"))
    assert [tuple(r) for r in missing.collect()] == [("B", "JSON file not found for ticker B")]
    report = validation.error_report(files=validation.with_ticker_prefix(missing))
    assert [tuple(r) for r in report.collect()] == [("files", "B: JSON file not found for ticker B")]
