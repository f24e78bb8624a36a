"""Reshaping: normalise, flatten, split, unnest, stringify; selection and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import canonical_ticker
from marketframe.operators import selection, shaping
from marketframe.plans import normalize_companies
from marketframe.sources import parsed_documents, shredded, unwrap_responses

from .registration import query
from .tables import (
    CUSTOMER_COMPANIES,
    EVENT_PRICES,
    INGESTED,
    ORDER_POINTS,
    customer_documents,
    customer_registry,
    event_prices,
    order_documents,
    part_registry,
    responses,
    table,
    ticker,
)


def parsed(bodies: DataFrame) -> DataFrame:
    """Documents in a text column, parsed as the readers do."""
    return shredded(parsed_documents(bodies.select("body"))).drop("broken")


def customer_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company records of all customers."""
    return shaping.typed_companies(parsed(customer_documents(spark, sf_dir)))


def order_companies(spark: SparkSession, sf_dir: str, junk: bool = False) -> DataFrame:
    return shaping.typed_companies(parsed(order_documents(spark, sf_dir, junk)))


@query("prj_canonical_ticker", "SELECT c_custkey, upper(c_name) AS ticker FROM customer")
def _(spark, sf_dir):
    messy = F.concat(F.lit(" \t"), F.lower("c_name"), F.lit("\n "))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", canonical_ticker(messy).alias("ticker")
    )


@query(
    "prj_normalize_company",
    f"""WITH {INGESTED}
SELECT requested, coalesce(error, '') AS error,
       CASE WHEN error IS NULL THEN id END AS id,
       CASE WHEN error IS NULL THEN CASE WHEN is_full THEN name ELSE 'Customer ' || id END END AS name,
       CASE WHEN error IS NULL THEN ticker END AS ticker,
       CASE WHEN error IS NULL AND is_full THEN segment END AS sector,
       CASE WHEN error IS NULL THEN CASE WHEN is_full THEN segment ELSE '' END END AS indices,
       CASE WHEN error IS NULL THEN CASE WHEN is_full THEN 1 ELSE 0 END END::BIGINT AS metrics,
       CASE WHEN error IS NULL THEN CASE WHEN is_full THEN 1 ELSE 0 END END::BIGINT AS points
FROM ingested""",
)
def _(spark, sf_dir):
    mapping = customer_registry(spark, sf_dir).withColumn(
        "name", F.concat(F.lit("Customer "), "id")
    )
    raw = selection.attach_mapping(unwrap_responses(responses(spark, sf_dir)), mapping)
    records = normalize_companies(raw)
    good = F.col("error").isNull()
    return records.select(
        "requested",
        F.coalesce("error", F.lit("")).alias("error"),
        *[F.when(good, F.col(c)).alias(c) for c in ("id", "name", "ticker", "sector")],
        F.when(good, F.array_join("indices", ",")).alias("indices"),
        F.when(good, F.size("aggregations")).cast("bigint").alias("metrics"),
        F.when(good, F.size("insights.stock_price")).cast("bigint").alias("points"),
    )


@query(
    "prj_flatten_aggregations",
    f"WITH {CUSTOMER_COMPANIES} SELECT id, ticker, acctbal, debt, nation FROM companies",
)
def _(spark, sf_dir):
    flat = shaping.flatten(customer_companies(spark, sf_dir), "aggregations", value_type="double")
    return flat.select("id", "ticker", "acctbal", "debt", "nation")


@query(
    "prj_flatten_prefixed",
    f"""WITH {CUSTOMER_COMPANIES}
SELECT id, last_updated_fundamentals, last_updated_stock_price FROM companies""",
)
def _(spark, sf_dir):
    flat = shaping.flatten(customer_companies(spark, sf_dir), "lastUpdated", prefix="last_updated")
    return flat.select("id", "last_updated_fundamentals", "last_updated_stock_price")


@query(
    "prj_json_string_props",
    """SELECT event_id,
       CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::DOUBLE END AS props_k,
       NULL::DOUBLE AS props_absent FROM events""",
)
def _(spark, sf_dir):
    """Props of errors are cut short, which makes them unreadable."""
    events = table(spark, sf_dir, "events").withColumn(
        "props",
        F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(
            F.col("props")
        ),
    )
    return shaping.flatten_json_text(
        events.select("event_id", "props"), "props", ["k", "absent"], prefix="props"
    )


@query(
    "prj_company_details",
    f"""WITH {CUSTOMER_COMPANIES}
SELECT id, name, ticker, sector, industry, description, indices, exchanges FROM companies""",
)
def _(spark, sf_dir):
    details = shaping.company_details(customer_companies(spark, sf_dir))
    return shaping.stringify_nested(details).drop("aggregations", "lastUpdated", "extra")


@query("prj_unnest_prices", f"WITH {ORDER_POINTS} SELECT * FROM points")
def _(spark, sf_dir):
    return shaping.unnest_prices(order_companies(spark, sf_dir))


@query("flt_object_points", f"WITH {ORDER_POINTS} SELECT * FROM points")
def _(spark, sf_dir):
    return shaping.unnest_prices(order_companies(spark, sf_dir, junk=True))


@query(
    "prj_stringify_nested",
    f"""WITH {CUSTOMER_COMPANIES}
SELECT id, indices, exchanges,
       '{{"fundamentals": "' || last_updated_fundamentals || '", "stock_price": "'
         || last_updated_stock_price || '"}}' AS updated,
       '{{"stock_price": [{{"ts": ' || ts || ', "value": ' || value::VARCHAR
         || ', "interval": 0, "valueUnit": "USD"}}]}}' AS insights
FROM companies""",
)
def _(spark, sf_dir):
    companies = customer_companies(spark, sf_dir)
    keys = ["fundamentals", "stock_price"]
    updated = F.struct(*[F.col("lastUpdated")[k].cast("string").alias(k) for k in keys])
    nested = companies.select("id", "indices", "exchanges", updated.alias("updated"), "insights")
    return shaping.stringify_nested(nested)


@query(
    "prj_stringify_text",
    "SELECT conv_id, turn, role, text, true AS ascii FROM conversations",
)
def _(spark, sf_dir):
    """Whole texts with accents and line breaks become ASCII JSON and come back unchanged."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array("role", "text").alias("said")
    )
    coded = shaping.stringify_nested(rows)
    back = F.from_json("said", "array<string>")
    return coded.select(
        "conv_id",
        "turn",
        back[0].alias("role"),
        back[1].alias("text"),
        (~F.col("said").rlike(r"[^\x00-\x7f]")).alias("ascii"),
    )


@query(
    "prj_move_to_end",
    f"WITH {CUSTOMER_COMPANIES} SELECT id, description, sector, 'description' AS last_column FROM companies",
)
def _(spark, sf_dir):
    rows = customer_companies(spark, sf_dir).select("id", "description", "sector")
    moved = shaping.move_to_end(rows, "description")
    return moved.withColumn("last_column", F.lit(moved.columns[-1]))


@query(
    "prj_typed_empty",
    f"""WITH {EVENT_PRICES}
SELECT company_id, ticker, ts, value, 0::BIGINT AS "interval", 'USD' AS "valueUnit" FROM prices""",
)
def _(spark, sf_dir):
    """Documents without points add no rows, and the typed empty table fits the price table."""
    pointless = customer_companies(spark, sf_dir).withColumn(
        "insights",
        F.struct(F.slice("insights.stock_price", 1, 0).alias("stock_price")),
    )
    prices = event_prices(spark, sf_dir).drop("pos")
    nothing = shaping.unnest_prices(pointless).drop("pos")
    return shaping.empty_prices(spark).union(nothing).union(prices)


@query(
    "prj_align_metrics",
    """SELECT event_id, """
    + ", ".join(
        f'CASE WHEN event_type = \'{t}\' THEN value END AS "{t}"'
        for t in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events",
)
def _(spark, sf_dir):
    """Every event is a record with its own single metric, named by the event type."""
    records = table(spark, sf_dir, "events").select(
        "event_id", F.create_map("event_type", F.col("value").cast("string")).alias("aggregations")
    )
    return shaping.aligned_metrics(records)


@query(
    "flt_targets",
    """SELECT coalesce(c_custkey + 1, 0) AS id, coalesce(c_name, 'T' || p_partkey) AS name,
       'T' || p_partkey AS ticker FROM part LEFT JOIN customer ON p_partkey = c_custkey""",
)
def _(spark, sf_dir):
    requested = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" t"), "p_partkey").alias("ticker")
    )
    return selection.select_targets(requested, customer_registry(spark, sf_dir))


@query(
    "jon_attach_mapping",
    """SELECT o_orderkey, 'T' || o_custkey AS ticker, c_custkey + 1 AS mapping_id,
       c_name AS mapping_name FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", ticker("o_custkey").alias("ticker"))
    return selection.attach_mapping(raw, customer_registry(spark, sf_dir))


@query(
    "jon_resume_anti",
    """SELECT c_custkey + 1 AS id, 'T' || c_custkey AS ticker FROM customer
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
)
def _(spark, sf_dir):
    return selection.without_existing(
        customer_registry(spark, sf_dir), event_prices(spark, sf_dir)
    ).select("id", "ticker")


@query(
    "jon_with_data_semi",
    """SELECT p_partkey + 1 AS id, 'T' || p_partkey AS ticker FROM part
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = p_partkey)""",
)
def _(spark, sf_dir):
    companies = table(spark, sf_dir, "orders").select(ticker("o_custkey").alias("ticker"))
    return selection.with_data(part_registry(spark, sf_dir), companies).select("id", "ticker")


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a registry of documents, whose datasets are: labelled documents (JSON), documents
    labelled good (CSV), labelled harmful (Parquet), conversations of the same number (SQL)."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents")
    mapping = documents.select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("name"),
        ticker("doc_id").alias("ticker"),
    )
    keyed = labels.select(ticker("doc_id").alias("ticker"), "quality", "toxic")
    return selection.status_matrix(
        mapping,
        {
            "json": keyed,
            "csv": keyed.where("quality = 1"),
            "parquet": keyed.where("toxic = 1"),
            "sql": table(spark, sf_dir, "conversations").select(ticker("conv_id").alias("ticker")),
        },
    )


DOCUMENT_STATUS = """
status AS (
  SELECT 'T' || d.doc_id AS ticker, source AS name,
         l.doc_id IS NOT NULL AS has_json, coalesce(quality = 1, false) AS has_csv,
         coalesce(toxic = 1, false) AS has_parquet,
         d.doc_id IN (SELECT conv_id FROM conversations) AS has_sql
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


@query("jon_status_matrix", f"WITH {DOCUMENT_STATUS} SELECT * FROM status")
def _(spark, sf_dir):
    return document_status(spark, sf_dir)


@query(
    "src_price_fallback",
    f"""WITH {ORDER_POINTS}, {EVENT_PRICES}
SELECT ticker, ts, value, pos FROM prices
UNION ALL
SELECT ticker, ts, value, pos FROM points WHERE ticker NOT IN (SELECT ticker FROM prices)""",
)
def _(spark, sf_dir):
    """Users with events have a price table of their own, the other customers have documents."""
    found = shaping.prices_with_fallback(
        event_prices(spark, sf_dir), order_companies(spark, sf_dir)
    )
    return found.select("ticker", "ts", "value", "pos")
