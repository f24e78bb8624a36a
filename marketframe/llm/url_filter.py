"""URL filter by a tree of path templates per host.

A path's segments are first generalised by their form (numbers, hexadecimal and long identifiers,
with or without a file ending). Then the tree is built from the top over distinct templates, never
over single URLs: where a node has many children for its rows they become one wildcard, and children
whose rate of labelled bad URLs and whose depth do not differ from those of the node's largest child
are merged into its branch. Paths go to their real depth; a stretch that all paths of a node share is
one step, so the rounds are as many as places where paths part. What is left are templates with counts of
labelled URLs; one is rejected when the smoothed share of bad ones among its labelled URLs is above the
threshold.

Labels come from the caller: true (bad), false (good) or null (unknown). Rows of one host or template
are summed before they are shuffled, so a host with a third of all URLs is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.workspace import materialized

#: A node with at least this many children, and less than this many rows per child, has a wildcard.
WIDE, ROWS_PER_CHILD = 12, 4
#: Smoothing: that many bad and good URLs are added to every template.
PRIOR_BAD, PRIOR_GOOD = 1.0, 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    known = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(known, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest) + 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(after, r"^[^?#]*", 0)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the ``(verdict, host/path)`` rules that fits, as its text; null if none does."""
    best = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith("/" + tail)
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def segments(path: Column) -> Column:
    """A path's segments, generalised by form."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")

    def form(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+(?:\.[A-Za-z]{1,5})?$"), "<number>")
            .when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2})?$"), "<date>")
            .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}(?:\.[A-Za-z]{1,5})?$"), "<hex>")
            .when(s.rlike(r"^(?=.*[0-9])[\w-]{24,}$"), "<id>")
            .otherwise(s)
        )

    return F.transform(parts, form)


def _skipped(nodes: DataFrame) -> DataFrame:
    """``nodes`` gone on to where the paths of a template part. What the smallest and the largest of them
    have in common at the front, all have."""
    rest = F.slice("segments", F.col("at") + 1, F.size("segments"))
    ends = nodes.groupBy("host", "template").agg(F.min(rest).alias("low"), F.max(rest).alias("high"))
    same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
    parting = F.array_position(same, F.lit(False)).cast("int")
    shared = ends.select("host", "template", F.when(parting == 0, F.size(same)).otherwise(parting - 1).alias("shared"))
    joined = nodes.join(shared, ["host", "template"])
    stretch = F.array_join(F.slice("segments", F.col("at") + 1, F.col("shared")), "/")
    on = joined.withColumn("template", F.when(F.col("shared") > 0, F.concat("template", F.lit("/"), stretch)).otherwise(F.col("template")))
    return materialized(on.withColumn("at", F.col("at") + F.col("shared")).select(*nodes.columns), "url-skipped")


def _branched(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the template's next element in place: kept, merged or a wildcard."""
    here = nodes.where(F.size("segments") > F.col("at")).withColumn("child", F.get("segments", F.col("at")))
    depth = F.sum(F.size("segments") * F.col("n")).alias("depth")
    children = materialized(
        here.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), depth),
        "url-children",
    )
    parents = children.groupBy("host", "template").agg(
        F.count("*").alias("m"), F.sum("n").alias("all"),
        F.max_by(F.struct("child", "n", "bad", "labelled", "depth"), F.struct("n", "child")).alias("top"),
    )
    wide = (F.col("m") >= WIDE) & (F.col("all") < ROWS_PER_CHILD * F.col("m"))
    pooled = (F.col("bad") + F.col("top.bad") + 0.5) / (F.col("n") + F.col("top.n") + 1)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("top.n")))
    alike = (
        (F.abs(F.col("bad") / F.col("n") - F.col("top.bad") / F.col("top.n")) <= 2 * spread)
        & (F.abs((F.col("labelled") - F.col("bad")) / F.col("n") - (F.col("top.labelled") - F.col("top.bad")) / F.col("top.n")) <= 0.1)
        & (F.abs(F.col("depth") / F.col("n") - F.col("top.depth") / F.col("top.n")) <= 0.5)
    )
    element = F.when(wide, F.lit("*")).when(alike & (F.col("m") > 1), F.concat(F.lit("{"), F.col("top.child"), F.lit("}"))).otherwise(F.col("child"))
    named = children.join(parents, ["host", "template"]).select("host", "template", "child", element.alias("element"))
    grown = here.join(named, ["host", "template", "child"]).withColumns(
        {"template": F.concat("template", F.lit("/"), "element"), "at": F.col("at") + 1}
    )
    ended = nodes.where(F.size("segments") <= F.col("at"))
    return materialized(grown.select(*nodes.columns).unionByName(ended), "url-branched")


def templates(urls: DataFrame) -> DataFrame:
    """``(host, segments, template, n, labelled, bad, purity)`` from ``(host, path, label)``: per host
    and generalised path, its template and the template's counts and smoothed share of bad URLs."""
    rows = urls.groupBy("host", segments(F.col("path")).alias("segments")).agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label")).alias("bad")
    )
    nodes = materialized(rows.withColumns({"template": F.lit(""), "at": F.lit(0)}), "url-nodes")
    while not nodes.where(F.size("segments") > F.col("at")).isEmpty():
        nodes = _branched(_skipped(nodes))
    sums = nodes.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + PRIOR_BAD) / (F.col("labelled") + PRIOR_BAD + PRIOR_GOOD)
    return nodes.select("host", "segments", "template").join(sums.withColumn("purity", purity), ["host", "template"])


#: Fixed list: words that make a URL a labelled bad one.
SEEDS = ("casino", "bet", "bets", "poker", "adult", "porn", "xxx", "sex", "ads", "adserver", "tracker", "viagra", "warez")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    threshold: float = 0.5,
    seeds: tuple[str, ...] = SEEDS,
    url_col: str = "url",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template`` and ``verdict`` (``allow``, ``block``).

    A URL that a rule fits has its verdict. URLs under a rule, and those whose host or path has one of
    ``seeds`` as a word, are the labelled ones; the rest is judged by its template. Null and malformed
    urls have an empty host and path, whose template is judged like any other. All rows and other
    columns stay (columns of the five names are replaced); repeated rows each count and come out
    alike; an empty table stays empty.
    """
    new = ("host", "path", "rule", "template", "verdict")
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    own = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    # Other columns travel in one struct, so that their names meet none of these.
    keyed = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for name, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(name)).otherwise(verdict)
    word = rf"(?i)(?:^|[^a-z])(?:{'|'.join(seeds)})(?:[^a-z]|$)"
    seeded = F.concat("host", "path").rlike(word)
    label = F.when(verdict == "block", True).when(verdict == "allow", False).when(seeded, True)
    found = templates(keyed.select("host", "path", label.alias("label")))
    found = materialized(found.select("host", "segments", "template", (F.col("purity") > threshold).alias("bad")), "url-templates")
    ruled = keyed.where(F.col("rule").isNotNull())
    free = keyed.where(F.col("rule").isNull()).withColumn("segments", segments(F.col("path")))
    met = free.join(found, ["host", "segments"], "left")
    rest = met.select("row.*", "host", "path", "rule", "template", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    fixed = ruled.select("row.*", "host", "path", "rule", F.lit(None).cast("string").alias("template"), verdict.alias("verdict"))
    return fixed.unionByName(rest)
