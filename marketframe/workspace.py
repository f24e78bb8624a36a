"""Shared storage for intermediate tables.

A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is always used when it
is present. Only a session without it (a test on one machine) gets a temporary local folder.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="marketframe-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/marketframe/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: both later branches see the same rows,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path, whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names directly below a path, none if it is not there. Files further down are not listed."""
    jvm = spark._jvm
    found = jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(jvm.org.apache.hadoop.fs.Path(f"{path}/*"))
    # One string for all names: a call for each would cost more than the listing.
    return [p.rpartition("/")[2] for p in found.mkString("\n").split("\n") if p]


# Spark lists up to this many folders in a task each, which costs far more than the listing.
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Reads of datasets that may have a folder per ticker: within the context, their folders are listed by
    ``spark.sql.shuffle.partitions`` tasks at most."""
    before = spark.conf.get(_LISTING_TASKS)
    tasks = min(int(before), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set(_LISTING_TASKS, str(tasks))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_TASKS, before)


class Scratch:
    """Intermediate tables of one operator, which goes on from table to table and removes those that
    nothing will read again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """As ``materialized``, with the path kept for ``drop``."""
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = (read, path)
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            removed(self.spark, path)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of queries that nothing refers to any more. It does so when
        the driver collects garbage, which may be long after an operator of many jobs has filled disks."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*(t for i, (t, _) in list(self.paths.items()) if i not in kept))
