"""Company documents and price tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.variants import elements, entries, kept_fraction, member, parsed_json
from ..schemas import DOCUMENT_SCHEMA, EXTRA, POSITIONED_PRICE_SCHEMA
from ..workspace import listing
from .arrays import array_elements

# Fixed value: how the error about a document that is no object begins.
UNEXPECTED = "Unexpected JSON structure: "


def _laid_out_by_ticker(spark: SparkSession, paths: list[str]) -> bool:
    return "ticker" in spark.read.text(paths).columns


def document_bodies(
    spark: SparkSession, path: str | Sequence[str], lines: bool = False, split: bool = False
) -> DataFrame:
    """``(source_path, body)`` of every JSON document, unparsed, and ``ticker`` from folders by ticker.

    ``lines=True`` takes one document per line; blank lines are left out. Otherwise a file is one array or
    one object: ``split`` cuts large arrays in parallel (``arrays.array_elements``).
    """
    paths = [path] if isinstance(path, str) else list(path)
    if split and not lines:
        return array_elements(spark, paths).select("source_path", "body")
    with listing(spark):
        schema = "value string, ticker string" if _laid_out_by_ticker(spark, paths) else "value string"
        rows = spark.read.schema(schema).text(paths, wholetext=not lines).where(F.col("value").rlike(r"\S"))
    others = [c for c in rows.columns if c != "value"]
    return rows.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("body"), *others)


def parsed_documents(bodies: DataFrame) -> DataFrame:
    """``bodies`` with ``doc VARIANT``, one row per document, and ``broken``: the text that is no JSON object.

    An array gives a row per element, an empty one none. The text is parsed once: the one-row generators
    keep filters from evaluating it again.
    """
    others = [c for c in bodies.columns if c != "body"]
    once = bodies.select("*", F.explode(F.array(parsed_json(F.col("body")))).alias("_root"))
    members = F.coalesce(elements(F.col("_root")), F.array("_root"))
    each = once.select(*others, "body", elements(F.col("_root")).isNotNull().alias("_listed"), F.explode(members).alias("doc"))
    text = F.when(F.col("_listed"), F.to_json("doc")).otherwise(F.col("body"))
    return each.select(*others, "doc", F.when(entries(F.col("doc")).isNull(), text).alias("broken"))


def _values(held: Column) -> Column:
    return F.transform_values(held, lambda k, v: kept_fraction(v))


def shredded(docs: DataFrame, column: str = "doc") -> DataFrame:
    """``docs`` with the known fields of a JSON object as columns (those of ``DOCUMENT_SCHEMA``) and all
    others in the map ``extra``, in place of the object."""
    doc = F.col(column)
    fields = {}
    for field in DOCUMENT_SCHEMA:
        name, kind = field.name, field.dataType
        if isinstance(kind, T.StructType):
            points = F.try_variant_get(doc, f"$.{name}.stock_price", "array<variant>")
            fields[name] = F.when(points.isNotNull(), F.struct(points.alias("stock_price")))
        elif isinstance(kind, T.MapType):
            fields[name] = _values(entries(member(doc, name)))
        else:
            fields[name] = F.try_variant_get(doc, f"$.{name}", kind.simpleString())
    fields[EXTRA] = _values(F.map_filter(entries(doc), lambda k, v: ~k.isin(*DOCUMENT_SCHEMA.names)))
    others = [F.col(f"`{c}`") for c in docs.columns if c != column and c not in fields]
    return docs.select(*(v.alias(n) for n, v in fields.items()), *others)


def read_companies(
    spark: SparkSession,
    path: str | Sequence[str],
    lines: bool = False,
    source_path: bool = False,
    split: bool = False,
) -> DataFrame:
    """Company documents from JSON files: the known fields as columns, all others in ``extra``.

    ``lines=False``: each file is one array or one object; an empty array gives no rows, and ``split``
    lets several tasks parse a large array. ``lines=True``: one document per line, which Spark splits, so
    it is the bulk format. In folders by ticker the folder's name is the ticker. A document that is no
    object stops the job (``quarantined`` goes on); a missing path fails at once.
    """
    docs = parsed_documents(document_bodies(spark, path, lines, split))
    problem = F.concat(F.lit(UNEXPECTED), "broken")
    sound = docs.where(F.when(F.col("broken").isNotNull(), F.raise_error(problem)).otherwise(F.lit(True)))
    by_folder = "ticker" in docs.columns
    found = shredded(sound.withColumnRenamed("ticker", "_folder") if by_folder else sound).drop("broken")
    if by_folder:
        found = found.withColumn("ticker", F.col("_folder")).drop("_folder")
    return found if source_path else found.drop("source_path")


class Quarantine(NamedTuple):
    companies: DataFrame
    broken: DataFrame
    counts: dict[str, int]


def quarantined(
    spark: SparkSession, path: str | Sequence[str], stage: str, lines: bool = True, split: bool = False
) -> Quarantine:
    """Company documents, and what is no document as rows ``(source_path, body)`` instead of an error.

    One scan: the parsed documents are written to ``stage``, both results read that, and the counts
    (``documents``, ``broken``) are observed while it is written.
    """
    seen = Observation("documents")
    docs = parsed_documents(document_bodies(spark, path, lines, split))
    found = shredded(docs.withColumnRenamed("ticker", "_folder") if "ticker" in docs.columns else docs)
    if "_folder" in found.columns:
        found = found.withColumn("ticker", F.col("_folder")).drop("_folder")
    good = F.col("broken").isNull()
    counted = found.observe(seen, F.count_if(good).alias("documents"), F.count_if(~good).alias("broken"))
    counted.write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(found.schema).parquet(stage)
    return Quarantine(
        staged.where(good).drop("broken"),
        staged.where(~good).select("source_path", F.col("broken").alias("body")),
        seen.get,
    )


def read_document_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Whole files as ``(source_path, body)``, for validation, which must see the raw JSON."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("body")
    )


def document_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of an NDJSON dataset as ``(source_path, body)``; blank lines are left out."""
    return (
        spark.read.text(path)
        .where(F.col("value").rlike(r"\S"))
        .select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("body"))
    )


def read_prices(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """A price table in any of the formats the sinks write. ``value`` is typed, so a value that is
    text in JSON reads as null instead of as a number."""
    reader = spark.read.schema(POSITIONED_PRICE_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
    elif fmt == "json":
        reader = reader.option("multiLine", multi_line).option("allowNonNumericNumbers", False)
    with listing(spark):
        return reader.format(fmt).load(path if isinstance(path, str) else list(path))


def ticker_of_path(path: Column) -> Column:
    """The parent folder's name when it is upper-case (``json/AAPL/x.json`` or ``ticker=AAPL``),
    else null. File URIs escape special characters, partition folders escape them once more."""
    folder = F.url_decode(F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)))
    name = F.regexp_replace(folder, "^ticker=", "")
    return F.when((name == F.upper(name)) & (name != F.lower(name)), name)


def with_path_ticker(docs: DataFrame, path: str = "source_path") -> DataFrame:
    """Set ``ticker`` from the folder name, or keep the document's own when the folder has none."""
    return docs.withColumn("ticker", F.coalesce(ticker_of_path(F.col(path)), F.col("ticker")))
