from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketframe.operators.shaping import typed_companies, unnest_prices
from marketframe.sources import (
    read_companies,
    read_mapping,
    read_mapping_entries,
    read_prices,
    unwrap_responses,
    with_path_ticker,
)

from .conftest import NOVA, QRTZ


@pytest.mark.parametrize(
    "body, count",
    [(f"[{NOVA},\n {QRTZ}]", 2), (NOVA, 1), ("[]", 0), ("\n[\n" + QRTZ + "\n]\n", 1)],
)
def test_array_object_or_nothing(spark, write, body, count):
    assert read_companies(spark, write("c.json", body)).count() == count


@pytest.mark.parametrize("body", ["5", '"text"', "true", "{broken"])
def test_scalar_root_fails(spark, write, body):
    docs = read_companies(spark, write("c.json", body))
    with pytest.raises(Exception, match="Unexpected JSON structure"):
        docs.collect()


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_companies(spark, str(tmp_path / "nothing.json"))


def test_lines(spark, sample_lines):
    docs = typed_companies(read_companies(spark, sample_lines, lines=True))
    assert [(r.id, r.ticker) for r in docs.orderBy("id").collect()] == [(1, "NOVA"), (2, "QRTZ")]
    assert unnest_prices(docs).count() == 8


def test_odd_values_do_not_spread(spark, write):
    body = (
        '{"id": "7", "ticker": "x", "aggregations": {"a": "n/a", "b": 2, "c": {"d": 1}},'
        ' "insights": {"stock_price": [{"ts": 1, "value": "2.5"}, 3, null, {"ts": 3, "value": "Infinity"}, {"ts": 5, "value": "-Infinity"}, {"ts": 2, "value": 4}]}}'
    )
    record = typed_companies(read_companies(spark, write("c.json", body)))
    row = record.select("id", F.to_json("aggregations").alias("aggregations"), "indices").head()
    assert row.id == 7 and row.aggregations == '{"a":"n/a","b":2,"c":{"d":1}}' and row.indices == []
    points = unnest_prices(record).select("ts", "value", "pos").orderBy("pos").collect()
    assert [tuple(p) for p in points] == [(1, None, 0), (3, None, 1), (5, None, 2), (2, 4.0, 3)]


def test_mapping_keeps_order(spark, write):
    path = write(
        "m.json",
        '[{"id": "2", "name": "B", "ticker": " bbb"}, 5, {"id": 1, "name": "A", "ticker": "AAA"}]',
    )
    rows = read_mapping(spark, path).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, 2, "B", "BBB"), (1, None, None, None), (2, 1, "A", "AAA")]


@pytest.mark.parametrize("body", ['{"id": 1}', "5", "no json"])
def test_mapping_must_be_an_array(spark, write, body):
    with pytest.raises(Exception, match="Mapping file must contain a JSON array"):
        read_mapping_entries(spark, write("m.json", body)).collect()


def test_unwrap(spark):
    good = '[{"result":{"data":{"json":{"company":{"id":9}}}}}]'
    null = '[{"result":{"data":{"json":{"company":null}}}}]'
    rows = [("A", good), ("B", null), ("C", "[]"), ("D", "{}"), ("E", "no json"), ("F", None)]
    found = unwrap_responses(spark.createDataFrame(rows, "ticker string, payload string"))
    errors = {r.ticker: r.error for r in found.collect()}
    assert errors["A"] is None and errors["B"] is None
    for t in "CDEF":
        assert errors[t] == f"Unexpected response shape for {t}"


def test_ticker_from_path(spark, tmp_path, write):
    write("json/AAPL/AAPL_company_details.json", '{"id": 1, "ticker": "other"}')
    write("json/ticker=BRK.B/part.json", '{"id": 2, "ticker": "other"}')
    write("json/mixed/part.json", '{"id": 3, "ticker": "own"}')
    paths = [str(p) for p in sorted(tmp_path.glob("json/*"))]
    docs = None
    for path in paths:
        part = with_path_ticker(read_companies(spark, path, source_path=True))
        docs = part if docs is None else docs.unionByName(part)
    assert {r.id: r.ticker for r in docs.collect()} == {"1": "AAPL", "2": "BRK.B", "3": "own"}


def test_price_file_types(spark, write):
    path = write("p.json", '[{"ticker": "A", "ts": 1, "value": 2.5}, {"ticker": "A", "value": "3"}]')
    rows = read_prices(spark, path, "json", multi_line=True).select("ts", "value").collect()
    assert sorted((r.ts is None, r.value) for r in rows if r.value) == [(False, 2.5)]
    assert len(rows) == 2
    assert read_prices(spark, path, "json", multi_line=True).where(F.col("value").isNull()).count() == 1


def test_array_files_are_written_line_by_line(spark, monkeypatch):
    from pyspark.sql import functions as F

    from catalog import QUERIES, storage

    plain, longest = storage.written_text, []

    def measuring(rows, label, by=None):
        longest.append(rows.agg(F.max(F.length("body"))).head()[0])
        return plain(rows, label, by)

    monkeypatch.setattr(storage, "written_text", measuring)
    found = QUERIES["src_array_split"](spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert longest[0] < 200  # no row holds a file
