"""Requests for some tickers read the folders of those tickers only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketframe.operators import metrics, selection
from marketframe.sinks import write_parquet
from marketframe.sources import read_companies, read_prices

from .plans_read import files_read

TICKERS = [f"T{i:02d}" for i in range(20)]


@pytest.fixture
def laid_out(spark, tmp_path, prices):
    path = str(tmp_path / "prices")
    write_parquet(prices({t: [1.0, 2.0, 4.0] for t in TICKERS}), path, by_ticker=True)
    return path


def _ask(spark, *tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def test_folders_are_listed_by_few_tasks(spark, tmp_path, prices):
    path = str(tmp_path / "many")  # more folders than Spark lists on the driver
    write_parquet(prices({f"T{i}": [1.0] for i in range(40)}), path, by_ticker=True)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("listing", "")
    try:
        assert read_prices(spark, path).columns[-1] == "ticker"
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert [s.numTasks for s in stages] == [4]  # spark.sql.shuffle.partitions, not one for each folder
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_few_tickers_become_a_predicate(spark, laid_out):
    narrow = selection.narrowing(_ask(spark, "T03", "T07", None, "T07"))
    found = narrow(read_prices(spark, laid_out))
    assert {r.ticker for r in found.collect()} == {"T03", "T07"}
    assert files_read(found) == 2
    assert files_read(selection.narrowing(_ask(spark, "NONE"))(read_prices(spark, laid_out))) == 0


def test_many_tickers_are_pruned_at_run_time(spark, tmp_path, laid_out):
    wanted = str(tmp_path / "wanted")
    _ask(spark, *TICKERS[:5]).write.parquet(wanted)
    narrow = selection.narrowing(spark.read.parquet(wanted), listed=2)
    found = narrow(read_prices(spark, laid_out))
    assert {r.ticker for r in found.collect()} == set(TICKERS[:5])
    assert files_read(found) <= 5 + 4  # the folders asked for, and the request itself


def test_a_report_reads_one_file_for_one_ticker(spark, laid_out):
    companies = _ask(spark, *TICKERS)
    report = metrics.metrics_report(_ask(spark, "t05", "none"), companies, read_prices(spark, laid_out))
    rows = {r.ticker: r for r in report.collect()}
    assert rows["T05"].observations == 3 and rows["T05"].error is None
    assert rows["NONE"].error == "Ticker not found"
    prices_only = metrics.metrics_report(_ask(spark, "t05"), companies, read_prices(spark, laid_out))
    known = 2  # the written list of known tickers may be read by each join
    assert files_read(prices_only) <= 1 + known
    gate = metrics.analytics_gate(_ask(spark, "T05", "T06", "none"), companies, read_prices(spark, laid_out))
    assert files_read(gate) <= 2 + known
    assert {r.ticker: (r.company_found, r.metrics_found, r.observations) for r in gate.collect()} == {
        "T05": (True, True, 3), "T06": (True, True, 3), "NONE": (False, False, None),
    }


@pytest.mark.parametrize("horizon", [0, 2, 63])
def test_reasons_without_metrics(spark, prices, horizon):
    table = prices({"GOOD": [1.0, None, 3.0, 2.0], "BAD": [None, float("nan")], "GONE": [5.0]})
    companies = _ask(spark, "GOOD", "BAD", "EMPTY", "MISSING", "GONE")
    landed = _ask(spark, "GOOD", "BAD", "EMPTY")
    asked = _ask(spark, "good", "bad", "empty", "missing", "other", "gone", "good")
    rows = {r.ticker: r for r in metrics.metrics_report(asked, companies, table, landed, horizon).collect()}
    assert {t: r.error for t, r in rows.items()} == {
        "GOOD": None, "BAD": "No valid price data found", "EMPTY": "No stock price data available",
        "MISSING": "Stock price data not found", "GONE": "Stock price data not found", "OTHER": "Ticker not found",
    }
    plain = metrics.price_metrics(table.where("ticker = 'GOOD'"), horizon).head()
    for name in metrics.METRICS:
        assert rows["GOOD"][name] == plain[name]
        assert rows["BAD"][name] is None


def test_documents_by_ticker_are_pruned(spark, tmp_path):
    path = str(tmp_path / "json")
    rows = spark.createDataFrame([(t, f'{{"id": 1, "ticker": "{t}"}}') for t in [*TICKERS, "007"]], "ticker string, value string")
    rows.repartition("ticker").write.partitionBy("ticker").text(path)
    found = selection.narrowing(_ask(spark, "007", "T01"))(read_companies(spark, path, lines=True))
    assert {r.ticker for r in found.select("ticker", F.to_json("extra")).collect()} == {"007", "T01"}
    assert files_read(found.select("ticker", "id")) == 2
