"""Compare registered queries with their SQL on DuckDB: ``python -m tests.oracle [sf_dir] [name…]``."""

from __future__ import annotations

import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def _normal(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """None when rows, columns and values agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if ours else "no rows"
    found = connection.execute(sql)
    columns = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = _normal(df.columns, ours), _normal(columns, theirs)
    if a != b:
        return (
            f"rows {len(ours)} vs {len(theirs)}; only ours {list((a - b).items())[:3]}; "
            f"only theirs {list((b - a).items())[:3]}"
        )
    return None if ours else "no rows"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = session(), duck(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as exc:
            problem = "".join(traceback.format_exception_only(exc))[:1500]
        took = time.time() - start
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
