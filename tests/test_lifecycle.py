from __future__ import annotations

import json

import pytest

from marketframe.operators.reports import ingest_counts, list_status, status_summary
from marketframe.operators.selection import status_matrix
from marketframe.plans import ingest, setup, update
from marketframe.sinks import write_json
from marketframe.sources import inventory, read_mapping

from .conftest import NOVA, QRTZ

MAPPING = "pos long, id long, name string, ticker string"


def envelope(company) -> str:
    text = company if isinstance(company, str) else json.dumps(company)
    return '[{"result":{"data":{"json":{"company":' + text + "}}}}]"


def landed(spark, **payloads):
    return spark.createDataFrame(list(payloads.items()), "ticker string, payload string")


def mapping(spark, *tickers):
    rows = [(i, 10 + i, f"Name {t}", t) for i, t in enumerate(tickers)]
    return spark.createDataFrame(rows, MAPPING)


def test_normalisation(spark):
    responses = landed(
        spark,
        FULL=envelope(NOVA),
        NONE=envelope("null"),
        EMPTY=envelope({}),
        BLANK=envelope({"indices": None, "exchanges": 0, "aggregations": "", "insights": False}),
        NULLNAME=envelope({"name": None}),
        NUMNAME=envelope({"name": 5}),
        BADLIST=envelope({"indices": ["a", 1]}),
        BADMAP=envelope({"aggregations": [1]}),
        TEXT=envelope('"oops"'),
        SHAPE="{}",
    )
    names = [r.ticker for r in responses.select("ticker").collect()]
    result = ingest(responses, mapping(spark, *names))
    log = {r.ticker: (r.status, r.error) for r in result.log.collect()}
    assert [t for t, (s, _) in log.items() if s == "fetched"] and log["NULLNAME"] == (
        "error", "name: not a valid string",
    )
    assert {t for t, (s, _) in log.items() if s == "fetched"} == {"FULL", "NONE", "EMPTY", "BLANK"}
    assert log["BADLIST"][1] == "indices: not a list of strings"
    assert log["BADMAP"][1] == "aggregations: not a valid object"
    assert log["TEXT"][1] == "record: not a valid object"
    assert log["SHAPE"][1] == "Unexpected response shape for SHAPE"
    companies = {r.id: r for r in result.companies.collect()}
    assert companies[10].name == "Nova Tidal Works" and companies[10].ticker == "NOVA"
    assert companies[11].name == "Name NONE" and companies[11].ticker == "NONE"
    assert companies[13].indices == [] and companies[13].aggregations == {}
    assert {r.company_id for r in result.prices.collect()} == {10}
    assert result.prices.count() == 5


def test_resume_and_absent_responses(spark):
    existing = spark.createDataFrame([("A",)], "ticker string")
    result = ingest(landed(spark, A="{}", B=envelope(QRTZ)), mapping(spark, "A", "B", "C"), existing)
    assert {r.ticker: r.status for r in result.log.collect()} == {
        "A": "skipped", "B": "fetched", "C": "error",
    }
    assert tuple(ingest_counts(result.log).head()) == (2, 1)


def test_setup(spark):
    requests = spark.createDataFrame([(0, "nova", None)], "pos long, ticker string, name string")
    registry, result = setup(spark, requests, landed(spark, NOVA=envelope(NOVA)))
    assert [tuple(r) for r in registry.collect()] == [(0, 1, "NOVA", "NOVA")]
    assert result.companies.head().id == 1


def test_update(spark, tmp_path):
    responses = landed(spark, NOVA=envelope(NOVA), QRTZ=envelope(QRTZ), BAD="{}")
    targets = mapping(spark, "NOVA", "QRTZ", "BAD")
    report = update(responses, targets, str(tmp_path / "out"))
    assert {(r.step, r.item): r.n for r in report.collect()} == {
        ("ingest", "success"): 2,
        ("ingest", "errors"): 1,
        ("convert", "converted"): 2,
        ("convert", "company_rows"): 2,
        ("convert", "price_rows"): 8,
        ("validate", "valid_records"): 2,
        ("validate", "record_errors"): 0,
    }
    skipped = update(responses, targets, str(tmp_path / "two"), validate=False)
    assert {r.step for r in skipped.collect()} == {"ingest", "convert"}


def test_update_resumes_on_top_of_earlier_data(spark, tmp_path):
    root = str(tmp_path / "out")
    targets = mapping(spark, "NOVA", "QRTZ")
    update(landed(spark, NOVA=envelope(NOVA)), targets, root, by_ticker=True)
    done = spark.createDataFrame([("NOVA",)], "ticker string")
    report = update(landed(spark, QRTZ=envelope(QRTZ)), targets, root, existing=done, by_ticker=True)
    found = {(r.step, r.item): r.n for r in report.collect()}
    assert found[("ingest", "success")] == 2 and found[("convert", "converted")] == 2
    assert found[("convert", "price_rows")] == 8


def test_status_labels(spark):
    have = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    matrix = status_matrix(
        mapping(spark, "A", "B", "C"),
        {"json": have("A", "B", "A"), "csv": have("A"), "parquet": have("A", "B"), "sql": have("A")},
    )
    labels = {r.ticker: r.status for r in list_status(matrix).collect()}
    assert labels == {"A": "Complete", "B": "JSON, Parquet", "C": "No data"}
    assert tuple(status_summary(matrix).head()) == (3, 2, 1)


def test_one_response_per_ticker(spark):
    rows = [("NOVA", envelope(NOVA)), (" nova", envelope(NOVA.replace("Tidal", "Wind"))), ("NOVA", envelope(NOVA))]
    result = ingest(spark.createDataFrame(rows, "ticker string, payload string"), mapping(spark, "NOVA"))
    assert result.companies.count() == 1 and result.prices.count() == 5
    assert {(r.status, r.error) for r in result.log.collect()} == {
        ("fetched", None), ("duplicate", "2 further responses for NOVA"),
    }


def test_update_of_chosen_tickers(spark, tmp_path):
    root = str(tmp_path / "out")
    ask = lambda *t: spark.createDataFrame([(i, x, "") for i, x in enumerate(t)], "pos long, ticker string, name string")
    update(landed(spark, NOVA=envelope(NOVA), QRTZ=envelope(QRTZ)), mapping(spark), root, by_ticker=True,
           requests=ask("NOVA", "QRTZ"), validate=False)
    before = {fmt: spark.read.text(f"{root}/{fmt}/company_details/ticker=QRTZ").collect() for fmt in ("json", "csv")}
    report = update(landed(spark, NOVA=envelope(NOVA.replace("Tidal", "Wind")), NEW="{}"), mapping(spark, "NOVA", "QRTZ"), root,
                    by_ticker=True, requests=ask(" nova", "new"), check_registry=True)
    found = {(r.step, r.item): r.n for r in report.collect()}
    assert found[("ingest", "success")] == 1 and found[("ingest", "errors")] == 1
    assert found[("convert", "converted")] == 1 and found[("validate", "mapping_errors")] == 0
    registered = {(r.id, r.ticker) for r in read_mapping(spark, f"{root}/registry", lines=True).collect()}
    assert registered == {(10, "NOVA"), (11, "QRTZ"), (12, "NEW")}
    for fmt, rows in before.items():
        assert spark.read.text(f"{root}/{fmt}/company_details/ticker=QRTZ").collect() == rows
        nova = spark.read.text(f"{root}/{fmt}/company_details/ticker=NOVA").collect()
        assert any("Nova Wind Works" in r.value for r in nova)
    for rows in inventory(spark, root).values():
        assert {r.ticker for r in rows.collect()} == {"NOVA", "QRTZ"}
    with pytest.raises(ValueError):
        update(landed(spark), mapping(spark), root, requests=ask("NOVA"))


def test_inventory_of_odd_names_and_of_nothing(spark, tmp_path, prices):
    path = str(tmp_path / "json" / "company_details")
    write_json(prices({"BRK/B": [1.0], "A+B": [1.0], "7": [1.0], "X Y%": [1.0]}), path, by_ticker=True)
    found = inventory(spark, str(tmp_path))
    assert {r.ticker for r in found["json"].collect()} == {"BRK/B", "A+B", "7", "X Y%"}
    assert found["sql"].isEmpty()
