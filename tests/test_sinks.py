from __future__ import annotations

import csv
import json
import sqlite3
from pathlib import Path

from pyspark.sql import functions as F

from marketframe import sinks
from marketframe.operators import shaping
from marketframe.plans import convert
from marketframe.sources import read_mapping, read_prices


def part_lines(path) -> list[str]:
    found = []
    for part in sorted(Path(path).rglob("part-*")):
        if not part.name.endswith(".crc"):
            found += part.read_text(encoding="utf-8").splitlines()
    return found


def test_convert_counts_and_files(spark, tmp_path, sample_companies):
    counts = convert(sample_companies, str(tmp_path / "out"))
    assert tuple(counts.head()) == (2, 2, 8)
    for fmt in ("csv", "parquet", "sql"):
        assert (tmp_path / "out" / fmt / "company_details").exists()


def test_csv_is_what_other_readers_expect(spark, tmp_path, sample_companies):
    path = tmp_path / "csv"
    sinks.write_csv(shaping.flattened_companies(sample_companies).coalesce(1), str(path))
    part = next(p for p in path.glob("part-*.csv"))
    with part.open(newline="", encoding="utf-8") as f:
        found = {r["ticker"]: r for r in csv.DictReader(f)}
    assert json.loads(found["NOVA"]["indices"]) == ["NORTH30"]
    assert found["NOVA"]["market_cap"] == "730000000"
    assert list(found["NOVA"])[-1] == "description"
    assert part.read_text().count('[""NORTH30""]') == 1


def test_empty_prices_leave_a_header_and_nothing_stale(spark, tmp_path, prices):
    path = str(tmp_path / "csv")
    sinks.write_csv(prices({"A": [1.0]}), path)
    sinks.write_csv(shaping.empty_prices(spark), path)
    assert read_prices(spark, path, "csv").count() == 0
    assert part_lines(path) == ["company_id,ticker,ts,value,interval,valueUnit"]


def test_script_runs_in_sqlite(spark, tmp_path):
    root = str(tmp_path / "sql")
    rows = [(1, "It's \"x\"", True, 1.5, 4118489404766.2354, ["a", "b"], ""), (2, None, False, None, 1e-7, None, "q")]
    df = spark.createDataFrame(
        rows, "id long, name string, good boolean, low double, big double, tags array<string>, note string"
    )
    sinks.write_sql(df, root, "companies")
    base = sqlite3.connect(":memory:")
    base.executescript("\n".join(part_lines(f"{root}/schema")))
    base.executescript("\n".join(part_lines(f"{root}/rows")))
    found = base.execute("SELECT * FROM companies ORDER BY id").fetchall()
    assert found == [
        (1, "It's \"x\"", 1, 1.5, 4118489404766.2354, '["a", "b"]', None),
        (2, None, 0, None, 1e-7, None, "q"),
    ]


def test_price_script_refers_to_the_given_table(spark, tmp_path, prices):
    table = prices({"A": [1.0, 2.0]}).drop("pos").select("company_id", "ticker", "ts", "value", "interval", "valueUnit")
    sinks.write_sql(table, str(tmp_path / "p"), "points", parent="firms")
    base = sqlite3.connect(":memory:")
    base.execute("CREATE TABLE firms (id INTEGER PRIMARY KEY)")
    base.execute("INSERT INTO firms VALUES (1)")
    base.execute("PRAGMA foreign_keys = ON")
    base.executescript("\n".join(part_lines(tmp_path / "p" / "schema") + part_lines(tmp_path / "p" / "rows")))
    assert base.execute('SELECT ts, value, "interval" FROM points ORDER BY ts').fetchall() == [
        (0, 1.0, 0),
        (86_400_000, 2.0, 0),
    ]


def test_schema_frame(spark):
    df = spark.sql("select 1L as id, 'x' as name, 1.5D as pe, true as ok, array('a') as tags")
    found = [tuple(r) for r in sinks.sql_schema(df, "t").orderBy("position").collect()]
    assert found == [
        ("t", 1, "id", "INTEGER", "PRIMARY KEY"),
        ("t", 2, "name", "TEXT", ""),
        ("t", 3, "pe", "REAL", ""),
        ("t", 4, "ok", "INTEGER", ""),
        ("t", 5, "tags", "TEXT", ""),
    ]
    fixed = {r.column_name: (r.sql_type, r.column_key) for r in sinks.price_sql_schema(spark).collect()}
    assert fixed["company_id"] == ("INTEGER", 'REFERENCES "companies"(id)')
    assert fixed["value"] == ("REAL", "")


def test_mapping_round_trip(spark, tmp_path):
    mapping = spark.createDataFrame(
        [(1, 5, "B", "B"), (0, 9, "é", "A")], "pos long, id long, name string, ticker string"
    )
    path = str(tmp_path / "mapping")
    sinks.write_mapping(mapping, path)
    assert all(isinstance(json.loads(line)["id"], str) for line in part_lines(path))
    assert [json.loads(line)["pos"] for line in part_lines(path)] == [0, 1]
    back = read_mapping(spark, path, lines=True).orderBy("pos").collect()
    assert [tuple(r) for r in back] == [(0, 9, "é", "A"), (1, 5, "B", "B")]


def test_overwrite_touches_only_its_tickers(spark, tmp_path, prices):
    path = str(tmp_path / "p")
    sinks.write_parquet(prices({"A": [1.0], "B": [2.0]}), path, by_ticker=True)
    sinks.write_parquet(prices({"B": [5.0, 6.0]}), path, by_ticker=True)
    found = sorted((r.ticker, r.value) for r in read_prices(spark, path).collect())
    assert found == [("A", 1.0), ("B", 5.0), ("B", 6.0)]


def test_saved_table(spark, prices):
    try:
        sinks.write_table(prices({"A": [1.0]}), "saved_prices")
        assert spark.table("saved_prices").count() == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS saved_prices")


def test_only_asked_formats_are_written(spark, tmp_path, sample_companies):
    convert(sample_companies, str(tmp_path / "out"), formats=("csv",))
    assert (tmp_path / "out" / "csv").exists()
    assert not (tmp_path / "out" / "parquet").exists() and not (tmp_path / "out" / "sql").exists()


def test_folders_are_spread_over_tasks(spark, tmp_path, prices):
    path = tmp_path / "p"
    sinks.write_parquet(prices({f"T{i}": [1.0] for i in range(40)}), str(path), by_ticker=True)
    parts = list(path.rglob("part-*.parquet"))
    assert len(parts) == 40
    assert len({p.name.split("-")[1] for p in parts}) == 4  # one task per shuffle partition, though the rows are few
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_files_of_suppliers_are_written_by_several_tasks(spark):
    from catalog.storage import _supplier_document, _supplier_files

    path = _supplier_files(spark, "/root/testdata/sf0.001", _supplier_document())
    parts = [p for p in Path(path.removeprefix("file:")).rglob("part-*") if not p.name.endswith(".crc")]
    folders = {p.parent.name for p in parts}
    assert len(parts) == len(folders) > 1 and len({p.name.split("-")[1] for p in parts}) > 1


def test_customer_documents_are_made_by_several_tasks(spark):
    from catalog.tables import customer_documents

    rows = customer_documents(spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_overwriting_suppliers_makes_no_folder_for_each(spark):
    from catalog import QUERIES

    found = QUERIES["lif_overwrite"](spark, "/root/testdata/sf0.01")
    assert {Path(name).parent.name for name in found.inputFiles()} == {"run=0", "run=1"}
    assert found.select("ticker").distinct().count() > 2 and {r.run for r in found.select("run").distinct().collect()} == {0, 1}
