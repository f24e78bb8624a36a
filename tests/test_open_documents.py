"""Documents with fields that are not known, broken lines, and large arrays."""

from __future__ import annotations

import csv
import json
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketframe import plans, sinks, sources
from marketframe.operators import shaping
from marketframe.plans import manifest, publishing, read_published, update_published

from .test_lifecycle import envelope, landed, mapping
from .test_sinks import part_lines

MIXED = [
    {"id": 1, "name": "a", "ticker": "A", "aggregations": {"pe": 17, "code": "12", "rate": 1.5, "ok": True, "odd": None},
     "employees": 12, "rank": 3, "tags": ["x", 1], "office": {"floor": 2.0, "zip": "0123"}, "lastUpdated": {"x": 5}},
    {"id": 2, "name": "b", "ticker": "B", "aggregations": {"pe": 2.5, "code": "x", "big": 9007199254740993}, "rank": 2.0,
     "flag": False},
    {"id": 3, "name": "c", "ticker": "C", "aggregations": {"big": 0.5, "code": 7}, "extra": "own"},
]


@pytest.fixture
def mixed(spark, write):
    path = write("mixed.ndjson", "\n".join(json.dumps(d) for d in MIXED) + "\n\n")
    return shaping.typed_companies(sources.read_companies(spark, path, lines=True))


def test_json_values_come_back_as_they_were(spark, tmp_path, mixed):
    sinks.write_json(shaping.company_details(mixed), str(tmp_path / "out"))
    lines = {d["id"]: d for d in map(json.loads, part_lines(tmp_path / "out"))}
    for document in MIXED:
        for field, value in document.items():
            assert lines[document["id"]][field] == value
            assert type(lines[document["id"]][field]) is type(value)
    assert '"rank":2.0' in "".join(part_lines(tmp_path / "out")) and '"code":"12"' in "".join(part_lines(tmp_path / "out"))
    again = shaping.typed_companies(sources.read_companies(spark, str(tmp_path / "out"), lines=True))
    assert {r[0] for r in again.select(F.to_json("extra")).collect()} == {r[0] for r in mixed.select(F.to_json("extra")).collect()}


def test_kinds_come_from_json_values(mixed):
    assert shaping.value_kinds(mixed, ["aggregations", "extra"]) == {
        "aggregations": {"big": "string", "code": "string", "odd": "double", "ok": "boolean", "pe": "double", "rate": "double"},
        "extra": {"employees": "bigint", "extra": "string", "flag": "boolean", "office": "string", "rank": "double", "tags": "string"},
    }


def test_fields_reach_parquet_csv_and_sql(spark, tmp_path, mixed):
    plans.convert(mixed, str(tmp_path))
    rows = {r.id: r for r in spark.read.parquet(str(tmp_path / "parquet" / "company_details")).collect()}
    assert (rows[1].code, rows[1].employees, rows[1].rank, rows[1].pe, rows[1].flag) == ("12", 12, 3.0, 17.0, None)
    assert json.loads(rows[1].office) == {"floor": 2.0, "zip": "0123"} and json.loads(rows[1].tags) == ["x", 1]
    assert (rows[2].rank, rows[2].flag, rows[2].big, rows[3].extra, rows[3].code) == (2.0, False, "9007199254740993", "own", "7")
    found = {}
    for part in (tmp_path / "csv" / "company_details").glob("part-*.csv"):
        with Path(part).open(newline="", encoding="utf-8") as f:
            found |= {r["ticker"]: r for r in csv.DictReader(f)}
    assert (found["A"]["employees"], found["A"]["code"], found["B"]["flag"]) == ("12", "12", "false")
    statements = "\n".join(part_lines(tmp_path / "sql" / "company_details" / "rows"))
    assert "'12'" in statements and '"employees"' in statements


def test_taken_names_are_refused(spark, write):
    path = write("c.json", '[{"id": 1, "ticker": "A", "aggregations": {"size": 1}, "Size": 2}]')
    with pytest.raises(ValueError, match="Size|size"):
        shaping.flattened_companies(shaping.typed_companies(sources.read_companies(spark, path)))


def test_broken_lines_are_rows(spark, tmp_path, write):
    path = write("d.ndjson", '{"id": 1, "name": "ok"}\n{"id": 2, \n\n5\n[{"id": 3}, "x"]\nnull\n{"id": 4}\n')
    found = sources.quarantined(spark, path, str(tmp_path / "stage"))
    assert {r.id for r in found.companies.collect()} == {"1", "3", "4"}
    assert sorted(r.body for r in found.broken.collect()) == ['"x"', "5", "null", '{"id": 2, ']
    assert found.counts == {"documents": 3, "broken": 4}
    assert all(r.source_path.endswith("d.ndjson") for r in found.broken.collect())
    empty = sources.quarantined(spark, write("e.ndjson", "\n"), str(tmp_path / "none"))
    assert empty.companies.count() == 0 and empty.counts == {"documents": 0, "broken": 0}


def _odd_text(rng):
    return "".join(rng.choices('ab"\\{}[],:\n é', k=rng.randint(0, 12)))


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split_bytes", ["64", "134217728"])
def test_split_arrays_equal_whole_ones(spark, write, indent, split_bytes):
    rng = random.Random(7)
    documents = [
        {"id": i, "name": _odd_text(rng), "nested": {_odd_text(rng): [{"a": _odd_text(rng)}, []], "e": {}}} for i in range(60)
    ]
    paths = [
        write("one.json", json.dumps(documents[:40], indent=indent, ensure_ascii=False)),
        write("two.json", "\n " + json.dumps(documents[40:59], indent=indent) + "\n"),
        write("three.json", json.dumps(documents[59])),
        write("four.json", " [ ] "),
        write("five.json", "\n"),
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sources.array_elements(spark, paths).collect()
        whole = sources.read_companies(spark, paths, split=True).select("id", "name").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_file = {}
    for r in rows:
        by_file.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.element, json.loads(r.body)))
    ordered = {name: [d for _, d in sorted(found, key=lambda x: x[0])] for name, found in by_file.items()}
    assert ordered == {"one.json": documents[:40], "two.json": documents[40:59], "three.json": documents[59:]}
    assert sorted((int(r.id), r.name) for r in whole) == [(d["id"], d["name"]) for d in documents]


def test_arrays_are_parsed_by_many_tasks(spark, write):
    path = write("a.json", json.dumps([{"id": i, "text": "x" * 50} for i in range(200)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        from marketframe.sources.arrays import fragments

        assert fragments(spark, [path]).select("piece").distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_chunks_of_a_split_change_no_element(spark, write, monkeypatch, bits):
    """No window spans a whole split; strings, objects and the ends of files go over the borders of chunks."""
    from marketframe.sources import arrays

    names = ["a}{", 'q"}\\', "]}[{", "", "\\\\}", "é}\n"]
    items = [{"id": i, "name": names[i % 6] * (i % 4), "more": {"deep": [{"x": "}"}] * (i % 3)}} for i in range(50)]
    paths = [
        write("a/list.json", "[ " + ",\n".join(json.dumps(x) for x in items) + "\n]\n"),
        write("a/one.json", json.dumps(items[5], indent=1)),
        write("a/open.json", json.dumps(items[:7])[:-1]),
        write("a/none.json", "[]"),
    ]
    monkeypatch.setattr(arrays, "CHUNK_BITS", bits)
    found = arrays.array_elements(spark, paths).collect()
    by_file = {}
    for r in sorted(found, key=lambda r: r.element):
        by_file.setdefault(r.source_path.rsplit("/", 1)[1], []).append(json.loads(r.body))
    assert by_file == {"list.json": items, "one.json": [items[5]], "open.json": items[:7]}


@pytest.mark.parametrize("body", ["[1, 2]", '[{"id": 1}, 5, {"id": 2}]', '{"id": 1', '"text"', '[{"id": 1}'])
def test_split_finds_what_is_no_document(spark, write, body):
    docs = sources.read_companies(spark, write("c.json", body), split=True)
    if body == '[{"id": 1}':  # an array that breaks off after a whole element
        assert docs.count() == 1
        return
    with pytest.raises(Exception, match="Unexpected JSON structure"):
        docs.collect()


def _prices(spark, root, fmt):
    found = read_published(spark, root, lambda run: sources.read_prices(spark, f"{run}/{fmt}/stock_price_insights", fmt))
    return None if found is None else sorted((r.ticker, r.value) for r in found.select("ticker", "value").collect())


def test_a_run_that_dies_between_formats_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")

    def company(value):
        return envelope({"insights": {"stock_price": [{"ts": 1, "value": value}]}})

    assert _prices(spark, root, "json") is None and manifest(spark, root).count() == 0
    update_published(landed(spark, A=company(1), B=company(2)), mapping(spark, "A", "B"), root, validate=False)
    first = [("A", 1.0), ("B", 2.0)]
    assert all(_prices(spark, root, fmt) == first for fmt in ("json", "csv", "parquet"))

    def broken(*args, **kwargs):
        raise OSError("disk is full")

    with monkeypatch.context() as m:
        m.setattr(sys.modules["marketframe.plans.convert"], "write_sql", broken)
        with pytest.raises(OSError):
            update_published(landed(spark, A=company(9)), mapping(spark, "A"), root, validate=False)
    assert (tmp_path / "out" / "runs" / "run=2" / "csv").exists()
    assert all(_prices(spark, root, fmt) == first for fmt in ("json", "csv", "parquet"))

    update_published(landed(spark, A=company(5), C="{}"), mapping(spark, "A", "C"), root, validate=False)
    assert all(_prices(spark, root, fmt) == [("A", 5.0), ("B", 2.0)] for fmt in ("json", "csv", "parquet"))
    report = update_published(landed(spark, A=company(6), D=company(7)), mapping(spark, "A", "D"), root, resume=True, validate=False)
    assert report.count() and _prices(spark, root, "parquet") == [("A", 5.0), ("B", 2.0), ("D", 7.0)]
    assert {r.ticker for r in publishing.published_inventory(spark, root)["sql"].collect()} == {"A", "B", "D"}


def test_published_runs_make_no_folder_for_each_ticker(spark, tmp_path):
    from catalog import QUERIES

    found = QUERIES["lif_published_prices"](spark, "/root/testdata/sf0.001")
    assert found.count() and not [name for name in found.inputFiles() if "ticker=" in name]
    root = str(tmp_path / "out")
    answers = landed(spark, A=envelope({"insights": {"stock_price": [{"ts": 1, "value": 1}]}}), B="{}")
    run, report = publishing.write_run(answers, mapping(spark, "A", "B"), root)
    assert run == 1 and {(r.step, r.item): r.n for r in report.collect()}[("ingest", "errors")] == 1
    for fmt in ("json", "csv", "parquet", "sql/company_details/rows"):
        assert (tmp_path / "out" / "runs" / "run=1" / fmt).exists()
    assert _prices(spark, root, "json") is None
    again, _ = publishing.write_run(answers, mapping(spark, "A", "B"), root, requests=spark.createDataFrame([(0, "a", "")], "pos long, ticker string, name string"))
    publishing.publish(spark, root, again, spark.createDataFrame([("A",)], "ticker string"))
    assert again == 2 and all(_prices(spark, root, fmt) == [("A", 1.0)] for fmt in ("json", "csv", "parquet"))


def test_an_unfinished_manifest_is_passed_over(spark, tmp_path):
    root = str(tmp_path / "out")
    tickers = spark.createDataFrame([("A",)], "ticker string")
    publishing.publish(spark, root, 1, tickers)
    (tmp_path / "out" / "manifest" / "version=2").mkdir()
    assert publishing.versions(spark, root) == [1]
    assert [tuple(r) for r in manifest(spark, root).collect()] == [("A", 1)]


def test_set_up_lasts(spark, tmp_path):
    root = str(tmp_path / "out")
    requests = spark.createDataFrame([(0, "nova", "Nova"), (1, "bad", None)], "pos long, ticker string, name string")
    responses = landed(spark, NOVA=envelope({"employees": 4}), BAD="{}")
    plans.setup(spark, requests, responses, root=root)
    registry = sources.read_mapping(spark, f"{root}/registry", lines=True)
    assert sorted((r.id, r.ticker) for r in registry.collect()) == [(1, "NOVA"), (2, "BAD")]
    companies = sources.read_companies(spark, f"{root}/json/company_details", lines=True)
    assert [(r.id, r.ticker, r.extra) for r in companies.select("id", "ticker", F.to_json("extra").alias("extra")).collect()] == [
        ("1", "NOVA", '{"employees":4}')
    ]
    more = spark.createDataFrame([(0, "new", None)], "pos long, ticker string, name string")
    plans.setup(spark, more, responses, mapping=registry, root=root)
    assert sorted((r.id, r.ticker) for r in sources.read_mapping(spark, f"{root}/registry", lines=True).collect()) == [
        (1, "NOVA"), (2, "BAD"), (3, "NEW"),
    ]
