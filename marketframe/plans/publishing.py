"""Updates that show in all formats at once, or not at all.

A run writes its companies and prices, in every format, below a folder of its own. Nothing reads that
folder until the run is published: a manifest ``(ticker, run)`` says in which run's folder each ticker
stands, and a new version of it, written whole, replaces the one before. A run that dies between two
formats leaves files that no manifest names, so every reader still sees the state before it. Since the
manifest says which tickers of a run count, a run is written whole, without a folder for every ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import FORMATS, narrowing
from ..workspace import folder_names
from .lifecycle import update

MANIFEST = "ticker string, run long"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of the manifest, oldest first."""
    names = folder_names(spark, f"{root}/manifest")
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
    return [v for v in found if "_SUCCESS" in folder_names(spark, f"{root}/manifest/version={v}")]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(ticker, run)`` of the newest version; without any, nothing is published."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={known[-1]}")


def publish(spark: SparkSession, root: str, run: int, tickers: DataFrame) -> None:
    """Write the next version: ``tickers`` stand in ``run`` now, all others where they were. Two runs that
    publish at once cannot both write the same version; the second one fails."""
    known = versions(spark, root)
    own = tickers.select("ticker").distinct()
    kept = manifest(spark, root).join(own, "ticker", "left_anti")
    version = known[-1] + 1 if known else 1
    new = kept.unionByName(own.withColumn("run", F.lit(run).cast("long")))
    new.write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")


def write_run(
    responses: DataFrame,
    mapping: DataFrame,
    root: str,
    requests: DataFrame | None = None,
    resume: bool = False,
    validate: bool = True,
) -> tuple[int, DataFrame]:
    """``plans.update`` into the next run's folder, which nothing reads before ``publish``. Returns the
    run's number and the report."""
    spark = responses.sparkSession
    runs = [int(n.partition("=")[2]) for n in folder_names(spark, f"{root}/runs") if n.startswith("run=")]
    run = max(runs, default=0) + 1
    existing = manifest(spark, root) if resume else None
    report = update(responses, mapping, f"{root}/runs/run={run}", existing, validate, requests=requests, alone=True)
    return run, report


def update_published(
    responses: DataFrame,
    mapping: DataFrame,
    root: str,
    requests: DataFrame | None = None,
    resume: bool = False,
    validate: bool = True,
) -> DataFrame:
    """A run (``write_run``), published when all formats are there.

    ``resume`` passes over tickers that the manifest has. Returns the report.
    """
    spark = responses.sparkSession
    run, report = write_run(responses, mapping, root, requests, resume, validate)
    log = spark.read.schema("ticker string, status string, error string").parquet(f"{root}/runs/run={run}/log")
    publish(spark, root, run, log.where("status = 'fetched'"))
    return report


def read_published(
    spark: SparkSession, root: str, read: Callable[[str], DataFrame], wanted: DataFrame | None = None
) -> DataFrame | None:
    """One dataset over all runs: ``read`` gets a run's folder, and of its rows those count that stand
    there by the manifest (and are ``wanted``). Runs without any such ticker are not opened. None when
    nothing is published; few runs are live at a time, since a full update supersedes all before it."""
    known = manifest(spark, root)
    if wanted is not None:
        known = narrowing(wanted)(known)
    live = sorted(r.run for r in known.select("run").distinct().collect())
    parts = [narrowing(known.where(F.col("run") == run))(read(f"{root}/runs/run={run}")) for run in live]
    return reduce(DataFrame.unionByName, parts) if parts else None


def published_inventory(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tickers in each format, as ``selection.status_matrix`` takes them: a published run has all."""
    return dict.fromkeys(FORMATS, manifest(spark, root).select("ticker"))
