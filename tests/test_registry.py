from __future__ import annotations

import json

from pyspark.sql import functions as F

from marketframe.operators import validation
from marketframe.operators import registry

MAPPING = "pos long, id long, name string, ticker string"
REQUESTS = "pos long, ticker string, name string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or ("pos",))).collect()]


def test_add_to_empty(spark):
    wanted = spark.createDataFrame([(5, " aapl", None), (7, "MSFT", "Microsoft")], REQUESTS)
    found = registry.add_tickers(registry.empty_mapping(spark), wanted)
    assert rows(found) == [(0, 1, "AAPL", "AAPL"), (1, 2, "Microsoft", "MSFT")]


def test_add_keeps_what_is_there(spark):
    mapping = spark.createDataFrame([(0, 7, "Apple", "AAPL"), (1, 3, "B", "B")], MAPPING)
    wanted = spark.createDataFrame(
        [(0, "aapl", "other"), (3, "Z", ""), (1, "new ", "First"), (2, "NEW", "Second")], REQUESTS
    )
    assert rows(registry.add_tickers(mapping, wanted)) == [
        (0, 7, "Apple", "AAPL"),
        (1, 3, "B", "B"),
        (2, 8, "First", "NEW"),
        (3, 9, "Z", "Z"),
    ]


def test_next_id(spark):
    assert registry.next_id(registry.empty_mapping(spark)).head()[0] == 1


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    numbered = registry.number_rows(df, "key")
    found = [r.seq for r in numbered.orderBy("key").collect()]
    assert found == list(range(1, 20_001))


def test_numbering_never_uses_one_task(spark):
    numbered = registry.number_rows(spark.range(100).withColumnRenamed("id", "key"), "key")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # numbers in a piece are stored with it
    assert plan.count("Exchange SinglePartition") == 1
    single = plan[plan.index("Exchange SinglePartition") :]
    assert single.splitlines()[1].strip(" :+-*()1234567890").startswith("HashAggregate(keys=[_part#")
    assert numbered.count() == 100


def test_resequence(spark):
    mapping = spark.createDataFrame([(1, 9, "b", "B"), (0, 4, "a", "A")], MAPPING)
    found = registry.resequence(mapping).select("pos", "id", "old_id")
    assert rows(found) == [(0, "1", 4), (1, "2", 9)]


def test_resequence_file_counts_every_element(spark):
    texts = [json.dumps(v) for v in ({"id": "9"}, 5, {"id": "2"})]
    entries = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").select(
        "pos", F.try_parse_json("text").alias("entry")
    )
    found = registry.resequence_entries(entries).select("pos", "new_id")
    assert rows(found) == [(0, "1"), (1, None), (2, "3")]


def test_repeats_without_unique_positions(spark):
    rows = [(0, 7, "A"), (0, 7, "B"), (1, None, "A"), (2, None, "C")]
    found = validation.duplicate_ids(spark.createDataFrame(rows, "pos long, id long, ticker string"))
    assert sorted(r.error for r in found.collect()) == ["Duplicate id detected: 7", "Duplicate id detected: null"]
