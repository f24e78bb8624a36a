from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.functions import (
    canonical_ticker,
    json_string,
    json_text,
    lax_integer,
    lax_integer_of,
    number_text,
    sql_literal,
)


def apply(spark, fn, values, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_canonical_ticker(spark):
    values = ["AAPL", " aapl ", "\tbrk.b\n", " msft ", "a b", "", None]
    assert apply(spark, canonical_ticker, values) == ["AAPL", "AAPL", "BRK.B", "MSFT", "A B", "", None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_lax_integer(spark, ansi):
    accepted = {"1": 1, " 7 ": 7, "1.0": 1, "+3": 3, "-4": -4, "1_000": 1000, "007": 7, "2.000": 2}
    rejected = ["1.5", "x", "", None, "1e3", "_1", "1__0", "1.", "99999999999999999999"]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert apply(spark, lax_integer, list(accepted)) == list(accepted.values())
        assert apply(spark, lax_integer, rejected) == [None] * len(rejected)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_lax_integer_of_json(spark):
    good = {"1": 1, '"1"': 1, '" 7 "': 7, '"1.0"': 1, "1.0": 1, '"+3"': 3, '"1_000"': 1000, "true": 1,
            "false": 0, "1e3": 1000}
    bad = ['"1.5"', "1.5", '"x"', "null", "{}", "[1]"]

    def parse(c):
        return lax_integer_of(F.try_parse_json(c))

    assert apply(spark, parse, list(good)) == list(good.values())
    assert apply(spark, parse, bad) == [None] * len(bad)


def test_json_string_matches_python(spark):
    values = ["plain", 'quo"te', "back\\slash", "tab\tline\n", "café", "日本語 x", "😀 é", "", "a/b"]
    assert apply(spark, json_string, values) == [json.dumps(v) for v in values]


def test_json_text_matches_python(spark):
    dtype = T.StructType(
        [
            T.StructField("a", T.ArrayType(T.StringType())),
            T.StructField("n", T.ArrayType(T.LongType())),
            T.StructField("d", T.DoubleType()),
        ]
    )
    rows = [((["x", None, "é"], [1, 2], 1.5),), ((None, [], 4118489404766.2354),), (None,)]
    df = spark.createDataFrame(rows, T.StructType().add("v", dtype))
    found = [r[0] for r in df.select(json_text(F.col("v"), dtype)).collect()]
    expected = [
        json.dumps({"a": ["x", None, "é"], "n": [1, 2], "d": 1.5}),
        json.dumps({"a": None, "n": [], "d": 4118489404766.2354}),
        None,
    ]
    assert found == expected
    mapped = spark.sql("select map('k', 1.5D, 'é', cast(null as double)) as v")
    assert mapped.select(json_text(F.col("v"), mapped.schema["v"].dataType)).head()[0] == json.dumps(
        {"k": 1.5, "é": None}
    )


def test_number_text_matches_python(spark):
    values = [0.0, 1.0, -2.5, 0.1, 1e7, 12345678.9, 4118489404766.2354, 112010000000.0, 1e15, 0.0001,
              0.000123456789, -0.00075, 999.25, 123456789012345.6]
    assert apply(spark, number_text, values, "double") == [repr(v) for v in values]


def test_sql_literal(spark):
    assert apply(spark, lambda c: sql_literal(c, T.StringType()), ["a", "it's", "", None]) == [
        "'a'", "'it''s'", "NULL", "NULL",
    ]
    assert apply(spark, lambda c: sql_literal(c, T.BooleanType()), [True, False, None], "boolean") == [
        "1", "0", "NULL",
    ]
    values = [1.5, float("nan"), float("inf"), None]
    assert apply(spark, lambda c: sql_literal(c, T.DoubleType()), values, "double") == [
        "1.5", "NULL", "NULL", "NULL",
    ]
    assert apply(spark, lambda c: sql_literal(c, T.LongType()), [5, None], "bigint") == ["5", "NULL"]


def test_negative_zero_keeps_its_sign_through_json(spark):
    from marketframe.functions.variants import parsed_json

    cases = {
        '{"a":-0.0}': '{"a":-0.0}',
        '{"a":[-0.00, 0.0,-0.05,-10.0],"b":"-0.0"}': '{"a":[-0.0,0,-0.05,-10],"b":"-0.0"}',
        '{"t":"x\\" -0.0 \\\\","n":-0.0,"m":-0.0e0}': '{"m":-0.0,"n":-0.0,"t":"x\\" -0.0 \\\\"}',
        '{"broken":-0.0': None,
        "-0.0": "-0.0",
        "-0.0x": None,
        '{"long":"' + "y-" * 50_000 + '","n":' + "[-0.0]}": '{"long":"' + "y-" * 50_000 + '","n":[-0.0]}',
    }
    rows = spark.createDataFrame([(c,) for c in cases], "body string")
    for row in rows.select("body", F.to_json(parsed_json(F.col("body"))).alias("back")).collect():
        assert row.back == cases[row.body]


def test_queries_keep_negative_zero(spark, tmp_path):
    from tests import oracle

    for name in oracle.TABLES:
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "customer":
            rows = rows.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.lit(-0.0)).otherwise(F.col("c_acctbal")))
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    connection = oracle.duckdb.connect()
    for name in oracle.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("prj_stringify_nested", "snk_json_text", "snk_sql_rows"):
        assert oracle.compare(spark, connection, str(tmp_path), name) is None, name
