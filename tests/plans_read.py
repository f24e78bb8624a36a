"""How many files an executed query has opened, from the metrics of its scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def files_read(df: DataFrame) -> int:
    df = df.select("*")  # a plan that has not run yet: files are counted in its first run only
    df.collect()
    return _files(df._jdf.queryExecution().executedPlan())


def _files(node) -> int:
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _files(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _files(node.plan())
    if kind.startswith("Reused"):
        return 0
    if kind.startswith("FileSourceScan"):
        return node.metrics().apply("numFiles").value()
    children = node.children()
    return sum(_files(children.apply(i)) for i in range(children.size()))
