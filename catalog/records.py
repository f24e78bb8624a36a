"""Validation of registry entries and company records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import lax_integer, lax_integer_of
from marketframe.operators import validation

from .registration import query
from .tables import customer_registry, order_prices, part_registry, supplier_registry, table, ticker

_ID_SQL = """CASE o_orderpriority
  WHEN '5-LOW' THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT END
  WHEN '4-NOT SPECIFIED' THEN NULL
  ELSE o_orderkey END"""


def _id_text():
    """Order keys in lax spellings; prices and plain words, most of which are no integers."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    return (
        F.when(priority == "1-URGENT", F.concat(F.lit(" "), key, F.lit("\t")))
        .when(priority == "2-HIGH", F.concat(F.lit("+"), key))
        .when(priority == "3-MEDIUM", F.concat(key, F.lit(".00")))
        .when(priority == "4-NOT SPECIFIED", priority)
        .otherwise(F.col("o_totalprice").cast("string"))
    )


@query(
    "val_int_coercion",
    f"SELECT o_orderkey, {_ID_SQL} AS from_text, {_ID_SQL} AS from_json FROM orders",
)
def _(spark, sf_dir):
    """The same spellings as plain text and as JSON values; prices are numbers in the JSON."""
    raw = F.when(F.col("o_orderpriority") == "5-LOW", F.col("text")).otherwise(
        F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    )
    rows = table(spark, sf_dir, "orders").withColumn("text", _id_text())
    return rows.select(
        "o_orderkey",
        lax_integer(F.col("text")).alias("from_text"),
        lax_integer_of(F.try_parse_json(raw)).alias("from_json"),
    )


def part_entries(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """Raw registry entries, one per part: size as id, part name as ticker, so both repeat a lot.
    ``faulty``: large parts lack the name, very large ones have text for an id."""
    size = F.col("p_size")
    name = F.concat(F.lit(', "name": "'), "p_brand", F.lit('"'))
    ident = F.concat(F.lit('{"id": '), size)
    if faulty:
        name = F.when(size > 48, F.lit("")).otherwise(name)
        ident = F.when(size > 49, F.lit('{"id": "big"')).otherwise(ident)
    body = F.concat(ident, name, F.lit(', "ticker": " '), "p_name", F.lit('"}'))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.try_parse_json(body).alias("entry")
    )


_DUP_SQL = """
SELECT pos, error FROM (
  SELECT p_partkey AS pos, 'Duplicate id detected: ' || p_size AS error,
         row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part
  UNION ALL
  SELECT p_partkey, 'Duplicate ticker detected: ' || upper(p_name),
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) FROM part
) WHERE n > 1"""


@query(
    "val_mapping_schema",
    """SELECT arg_min(p_partkey, p_partkey) AS pos,
       arg_min(CASE WHEN p_size > 49 THEN 'id: not a valid integer; name: field required'
                    ELSE 'name: field required' END, p_partkey) AS error,
       0::BIGINT AS mapping_entries
FROM part WHERE p_size > 48""",
)
def _(spark, sf_dir):
    """One bad entry voids the registry: one error, no entries counted, no duplicates reported."""
    entries = part_entries(spark, sf_dir, faulty=True)
    count = validation.mapping_count(entries).scalar()
    return validation.mapping_errors(entries).withColumn("mapping_entries", count)


@query("val_mapping_errors", _DUP_SQL)
def _(spark, sf_dir):
    return validation.mapping_errors(part_entries(spark, sf_dir))


@query(
    "val_dup_id", f"SELECT * FROM ({_DUP_SQL}) WHERE error LIKE 'Duplicate id%'"
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("id")
    )
    return validation.duplicate_ids(rows)


@query(
    "val_dup_ticker", f"SELECT * FROM ({_DUP_SQL}) WHERE error LIKE 'Duplicate ticker%'"
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("ticker")
    )
    return validation.duplicate_tickers(rows)


def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company document per text, whose faults follow language and labels.

    No label: name absent. Toxic: indices null. Poor quality: id is text. French: sector is a
    number. German: aggregations is a list. Spanish: the object stands alone, elsewhere in an array
    before a null.
    """
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    rows = documents.join(labels, documents.doc_id == labels.labelled, "left")
    lang = F.col("lang")
    quoted = F.to_json(F.array("text"))
    record = F.concat(
        F.lit('{"id": '),
        F.when(F.col("quality") == 0, F.lit('"poor"')).otherwise(F.col("doc_id").cast("string")),
        F.when(F.col("labelled").isNotNull(), F.concat(F.lit(', "name": "'), "source", F.lit('"'))).otherwise(""),
        F.lit(', "ticker": "'), lang, F.lit('", "description": '),
        quoted.substr(F.lit(2), F.length(quoted) - 2),
        F.when(F.col("toxic") == 1, F.lit(', "indices": null')).otherwise(', "indices": ["a", "b"]'),
        F.when(lang == "fr", F.lit(', "sector": 5')).otherwise(', "sector": null'),
        F.when(lang == "de", F.lit(', "aggregations": []')).otherwise(', "aggregations": {"pe": 1}'),
        F.lit(', "unknown": true}'),
    )
    body = F.when(lang == "es", record).otherwise(F.concat(F.lit("["), record, F.lit(", null]")))
    return rows.select("doc_id", ticker("doc_id").alias("ticker"), body.alias("body"))


_FAULTS = """
faults AS (
  SELECT d.doc_id, lang,
         [CASE WHEN quality = 0 THEN 'id: not a valid integer' END,
          CASE WHEN l.doc_id IS NULL THEN 'name: field required' END,
          CASE WHEN lang = 'fr' THEN 'sector: not a valid string' END,
          CASE WHEN toxic = 1 THEN 'indices: not a list of strings' END,
          CASE WHEN lang = 'de' THEN 'aggregations: not a valid object' END] AS problems,
         coalesce(array_to_string(problems, '; '), '') AS problem_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def checked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = validation.document_records(document_bodies(spark, sf_dir))
    return validation.checked_records(records)


@query(
    "val_record_schema",
    f"""WITH {_FAULTS}
SELECT * FROM (SELECT doc_id, 1::BIGINT AS record_index, unnest(problems) AS error FROM faults)
WHERE error IS NOT NULL
UNION ALL
SELECT doc_id, 2, 'record: not a valid object' FROM faults WHERE lang <> 'es'""",
)
def _(spark, sf_dir):
    return validation.field_errors(checked_documents(spark, sf_dir)).drop("ticker")


_ROW_ERRORS = f"""{_FAULTS},
row_errors AS (
  SELECT doc_id, 1::BIGINT AS record_index,
         'Record 1: ' || problem_text AS error
  FROM faults WHERE problem_text <> ''
  UNION ALL
  SELECT doc_id, 2, 'Record 2: record: not a valid object' FROM faults WHERE lang <> 'es'
)"""


@query("val_error_rows", f"WITH {_ROW_ERRORS} SELECT doc_id, record_index, error FROM row_errors")
def _(spark, sf_dir):
    return validation.record_errors(checked_documents(spark, sf_dir)).drop("ticker")


@query(
    "val_file_errors",
    """SELECT page_id, 'Invalid JSON' AS error FROM pages
UNION ALL
SELECT 1000000 + conv_id * 1000 + turn,
       'Invalid JSON structure: expected array or object, got ' ||
       CASE WHEN role = 'user' THEN 'str' ELSE 'int' END FROM conversations""",
)
def _(spark, sf_dir):
    """Bodies that are no documents at all: web pages, bare strings, bare numbers."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body"))
    talk = table(spark, sf_dir, "conversations")
    quoted = F.to_json(F.array("text"))
    bare = talk.select(
        (1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"),
        F.when(F.col("role") == "user", quoted.substr(F.lit(2), F.length(quoted) - 2))
        .otherwise(F.length("text").cast("string"))
        .alias("body"),
    )
    checked = validation.checked_records(validation.document_records(pages.unionByName(bare)))
    return validation.record_errors(checked).select("page_id", "error")


@query(
    "val_all_tickers",
    f"""WITH {_ROW_ERRORS}
SELECT 'T' || doc_id AS ticker, 'T' || doc_id || ': ' || error AS error FROM row_errors""",
)
def _(spark, sf_dir):
    errors = validation.record_errors(checked_documents(spark, sf_dir))
    return validation.with_ticker_prefix(errors).select("ticker", "error")


@query(
    "val_missing",
    """SELECT 'T' || p_partkey AS ticker,
       'JSON file not found for ticker T' || p_partkey AS error
FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(spark, sf_dir):
    return validation.missing_datasets(part_registry(spark, sf_dir), customer_registry(spark, sf_dir))


@query(
    "val_referential",
    """SELECT 'price->company' AS relation, o_custkey::VARCHAR AS key, count(*) AS row_count
FROM orders WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = o_custkey AND p_size > 10)
GROUP BY o_custkey
UNION ALL
SELECT 'company->mapping', (p_partkey)::VARCHAR, 1 FROM part
WHERE p_size > 10 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)""",
)
def _(spark, sf_dir):
    """Companies are the larger parts; their registry is the supplier table."""
    companies = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"))
    mapping = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return validation.reference_errors(order_prices(spark, sf_dir), companies, mapping)


@query(
    "val_business_rules",
    """SELECT * FROM (SELECT doc_id, ticker, unnest([
         CASE WHEN name = '' THEN 'name: must not be empty' END,
         CASE WHEN ticker = '' THEN 'ticker: must not be empty' END,
         CASE WHEN ticker <> '' AND (length(ticker) > 10 OR NOT regexp_full_match(ticker, '[A-Z0-9.\\-]*'))
              THEN 'ticker: unusual format' END]) AS error
FROM (SELECT d.doc_id,
             CASE WHEN toxic = 1 THEN '' ELSE source END AS name,
             CASE lang WHEN 'es' THEN '' WHEN 'de' THEN source WHEN 'fr' THEN 'FR-' || d.doc_id * 10000
                       ELSE 'EN.' || d.doc_id END AS ticker
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)) WHERE error IS NOT NULL""",
)
def _(spark, sf_dir):
    """English tickers are fine, German ones lower-case, French ones often too long, Spanish empty."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    lang = F.col("lang")
    code = (
        F.when(lang == "es", F.lit(" "))
        .when(lang == "de", F.col("source"))
        .when(lang == "fr", F.concat(F.lit("FR-"), F.col("doc_id") * 10000))
        .otherwise(F.concat(F.lit("EN."), "doc_id"))
    )
    rows = documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("source")).alias("name"),
        F.trim(code).alias("ticker"),
    )
    return validation.business_errors(rows)


@query(
    "set_error_report",
    f"""WITH {_ROW_ERRORS}
SELECT 'mapping' AS source, error FROM ({_DUP_SQL})
UNION ALL
SELECT 'records', 'T' || doc_id || ': ' || error FROM row_errors""",
)
def _(spark, sf_dir):
    errors = validation.record_errors(checked_documents(spark, sf_dir))
    return validation.error_report(
        mapping=validation.mapping_errors(part_entries(spark, sf_dir)),
        records=validation.with_ticker_prefix(errors),
    )


@query(
    "agg_validation_totals",
    f"""WITH {_ROW_ERRORS}
SELECT 'mapping_entries' AS item, count(*) AS n FROM part
UNION ALL SELECT 'mapping_errors', count(*) FROM ({_DUP_SQL})
UNION ALL SELECT 'valid_records', count(*) FROM faults WHERE problem_text = ''
UNION ALL SELECT 'record_errors', count(*) FROM row_errors""",
)
def _(spark, sf_dir):
    entries = part_entries(spark, sf_dir)
    return validation.validation_totals(
        entries, checked_documents(spark, sf_dir), validation.mapping_errors(entries)
    )


@query(
    "val_registered_suppliers",
    """SELECT 'price->company' AS relation, l_partkey::VARCHAR AS key, count(*) AS row_count
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey)
GROUP BY l_partkey""",
)
def _(spark, sf_dir):
    return validation.orphan_keys(
        table(spark, sf_dir, "lineitem"),
        "l_partkey",
        supplier_registry(spark, sf_dir).withColumn("key", F.col("id") - 1),
        "key",
        "price->company",
    )
