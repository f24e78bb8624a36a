from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marketframe.operators import shaping
from marketframe.operators.selection import select_targets, status_matrix
from marketframe.schemas import PRICE_SCHEMA


def test_flattened_sample(sample_companies):
    flat = shaping.flattened_companies(sample_companies)
    assert flat.columns == [
        "id", "name", "ticker", "sector", "industry", "indices", "exchanges", "market_cap", "pe", "rating",
        "last_updated_fundamentals", "last_updated_stock_price", "description",
    ]
    row = flat.where("ticker = 'NOVA'").head()
    assert (row.pe, row.market_cap, row.rating, row.last_updated_stock_price) == (17, 730_000_000, "BBB+", "2021-06-06")


def test_collision_is_refused(spark):
    df = spark.sql("select 1 as id, named_struct('ID', 2) as aggregations")
    with pytest.raises(ValueError, match="ID"):
        shaping.flatten(df, "aggregations")


def test_absent_column_is_a_no_op(spark):
    df = spark.range(1)
    assert shaping.flatten(df, "aggregations") is df
    assert shaping.move_to_end(df, "description") is df


def test_struct_in_place_and_null_container(spark):
    df = spark.sql("select 1 as a, named_struct('x', 5, 'y', 'q') as s, 2 as b "
                   "union all select 2, null, 3")
    flat = shaping.flatten(df, "s")
    assert flat.columns == ["a", "x", "y", "b"]
    assert [tuple(r) for r in flat.orderBy("a").collect()] == [(1, 5, "q", 2), (2, None, None, 3)]


def test_json_text_column(spark):
    rows = [(1, '{"a": "1.5", "b": "x"}'), (2, "broken"), (3, None), (4, "[1]"), (5, '{"a": {"z": 1}}')]
    df = spark.createDataFrame(rows, "i int, props string")
    flat = shaping.flatten_json_text(df, "props", ["a", "b"], prefix="props").orderBy("i")
    assert [tuple(r)[1:] for r in flat.collect()] == [(1.5, None)] + [(None, None)] * 4


def test_stringify_matches_python(spark):
    df = spark.sql("select array('SP500', 'DJIA') as a, array('é', null) as b, cast(null as array<string>) c, 1 as d")
    row = shaping.stringify_nested(df, exclude=["d"]).head()
    assert row.a == json.dumps(["SP500", "DJIA"])
    assert row.b == json.dumps(["é", None])
    assert row.c is None and row.d == 1
    assert shaping.stringify_nested(df, exclude=["a"]).schema["a"].dataType.typeName() == "array"


def test_typed_empty(spark):
    assert shaping.empty_prices(spark).schema == PRICE_SCHEMA
    assert shaping.empty_prices(spark).count() == 0


def test_aligned_metrics(spark):
    df = spark.sql("select 1 as id, map('b', '1', 'a', 'x') as aggregations "
                   "union all select 2, map('c', '3') union all select 3, null")
    wide = shaping.aligned_metrics(df).orderBy("id")
    assert wide.columns == ["id", "a", "b", "c"]
    assert [tuple(r)[1:] for r in wide.collect()] == [("x", 1, None), (None, None, 3), (None,) * 3]


def test_fallback_is_per_ticker(spark, sample_companies, prices):
    own = prices({"NOVA": [1.0, 2.0]})
    found = shaping.prices_with_fallback(own, sample_companies)
    counts = {r.ticker: r["count"] for r in found.groupBy("ticker").count().collect()}
    assert counts == {"NOVA": 2, "QRTZ": 3}
    empty = shaping.prices_with_fallback(prices({}), sample_companies)
    assert empty.count() == 8


def test_targets(spark):
    mapping = spark.createDataFrame([(0, 4, "Nova", "NOVA")], "pos long, id long, name string, ticker string")
    wanted = spark.createDataFrame([(" nova",), ("new",), ("NEW ",)], "ticker string")
    rows = {tuple(r) for r in select_targets(wanted, mapping).collect()}
    assert rows == {(4, "Nova", "NOVA"), (0, "NEW", "NEW")}


def test_status_matrix_without_data(spark):
    mapping = spark.createDataFrame([(0, 1, "a", "A")], "pos long, id long, name string, ticker string")
    nothing = spark.createDataFrame([], "ticker string")
    row = status_matrix(mapping, dict.fromkeys(("json", "csv", "parquet", "sql"), nothing)).head()
    assert tuple(row) == ("A", "a", False, False, False, False)


def test_no_python_workers(spark, sample_companies):
    flat = shaping.stringify_nested(shaping.flattened_companies(sample_companies, ["pe"], ["stock_price"]))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert flat.where(F.col("indices") == '["NORTH30"]').count() == 1


def test_metric_kinds_are_kept(spark):
    rows = [("A", {"n": "9007199254740993", "r": "AAA", "b": "true", "d": "1", "z": "007"}), ("B", {"n": "2", "d": "2.5", "m": "9007199254740993"}), ("C", {"m": "0.5", "e": None})]
    df = spark.createDataFrame(rows, "ticker string, aggregations map<string,string>")
    assert shaping.metric_types(df, "aggregations") == {
        "b": "boolean", "d": "double", "e": "double", "m": "string", "n": "bigint", "r": "string", "z": "string",
    }
    row = shaping.aligned_metrics(df).where("ticker = 'A'").head()
    assert (row.n, row.r, row.b, row.d, row.z) == (9007199254740993, "AAA", True, 1.0, "007")
    assert shaping.long_metrics(df).count() == 10


def test_keys_that_differ_by_case_are_refused(spark):
    df = spark.createDataFrame([("A", {"PE": "1", "pe": "2"})], "ticker string, aggregations map<string,string>")
    with pytest.raises(ValueError, match="pe"):
        shaping.aligned_metrics(df)
