"""The given tables seen as prices, companies, registry entries and landed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows that become much more work than their bytes show: a file of one scan task, over all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ticker(key: str | Column) -> Column:
    return F.concat(F.lit("T"), F.col(key) if isinstance(key, str) else key)


def epoch_ms(c: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session time zone."""
    return F.expr(f"({c} - TIMESTAMP_NTZ '1970-01-01 00:00:00') div INTERVAL '0.001' SECOND")


def price_columns(company_id: str, ts: str, value: str, pos: str) -> list[Column]:
    return [
        F.col(company_id).alias("company_id"),
        ticker(company_id).alias("ticker"),
        epoch_ms(ts).alias("ts"),
        F.col(value).alias("value"),
        F.lit(0).cast("bigint").alias("interval"),
        F.lit("USD").alias("valueUnit"),
        F.col(pos).alias("pos"),
    ]


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*price_columns("user_id", "ts", "value", "event_id"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        *price_columns("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    )


#: The event series as the SQL side sees it.
EVENT_PRICES = """
prices AS (
  SELECT user_id AS company_id, 'T' || user_id AS ticker, epoch_us(ts) // 1000 AS ts, value,
         event_id AS pos
  FROM events
)"""

ORDER_PRICES = """
prices AS (
  SELECT o_custkey AS company_id, 'T' || o_custkey AS ticker, epoch_us(o_orderdate) // 1000 AS ts,
         o_totalprice AS value, o_orderkey AS pos
  FROM orders
)"""


def registry(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A registry ``(pos, id, name, ticker)`` out of a keyed table."""
    return rows.select(
        F.col(key).alias("pos"),
        (F.col(key) + 1).alias("id"),
        F.col(name).alias("name"),
        ticker(key).alias("ticker"),
    )


def customer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(table(spark, sf_dir, "customer"), "c_custkey", "c_name")


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")


def part_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(table(spark, sf_dir, "part"), "p_partkey", "p_name")


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company document per customer, as JSON text in ``body``.

    Metrics differ from record to record (``acctbal`` or ``debt``), a description is there only for
    some, and the ticker needs canonical form.
    """
    customer = spread(table(spark, sf_dir, "customer"), "c_custkey")
    nation = table(spark, sf_dir, "nation")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    balance = F.col("c_acctbal")
    metrics = F.map_filter(
        F.create_map(
            F.lit("acctbal"), F.when(balance >= 0, balance),
            F.lit("debt"), F.when(balance < 0, -balance),
            F.lit("nation"), F.col("n_nationkey").cast("double"),
        ),
        lambda k, v: v.isNotNull(),
    )
    document = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit(" \tt"), "c_custkey", F.lit("\n")).alias("ticker"),
        F.col("c_mktsegment").alias("sector"),
        F.col("n_name").alias("industry"),
        F.when(
            balance >= 0, F.concat(F.lit('The "'), "c_name", F.lit("\", it's\nin "), "n_name")
        ).alias("description"),
        F.array("c_mktsegment", "n_name").alias("indices"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.array("n_name")).alias("exchanges"),
        metrics.alias("aggregations"),
        F.struct(
            F.array(
                F.struct(
                    (F.col("c_custkey") * DAY_MS).alias("ts"),
                    balance.alias("value"),
                    F.lit(0).alias("interval"),
                    F.lit("USD").alias("valueUnit"),
                )
            ).alias("stock_price")
        ).alias("insights"),
        F.create_map(
            F.lit("stock_price"), F.col("c_custkey") * 1000, F.lit("fundamentals"), F.col("c_custkey")
        ).alias("lastUpdated"),
    )
    return joined.select("c_custkey", F.to_json(document).alias("body"))


#: The same documents after shaping, as the SQL side sees them.
CUSTOMER_COMPANIES = """
companies AS (
  SELECT c_custkey AS id, c_name AS name, 'T' || c_custkey AS ticker, c_mktsegment AS sector,
         n_name AS industry,
         CASE WHEN c_acctbal >= 0
              THEN 'The "' || c_name || '", it''s' || chr(10) || 'in ' || n_name END AS description,
         '["' || c_mktsegment || '", "' || n_name || '"]' AS indices,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN '["' || n_name || '"]' ELSE '[]' END AS exchanges,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal,
         CASE WHEN c_acctbal < 0 THEN -c_acctbal END AS debt,
         n_nationkey::DOUBLE AS nation,
         (c_custkey)::VARCHAR AS last_updated_fundamentals,
         (c_custkey * 1000)::VARCHAR AS last_updated_stock_price,
         c_custkey * 86400000 AS ts, c_acctbal AS value
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def order_documents(spark: SparkSession, sf_dir: str, junk: bool = False) -> DataFrame:
    """One company document per order with two price points; with ``junk``, scalars and nulls
    stand between the points."""
    orders = table(spark, sf_dir, "orders")
    first = F.to_json(
        F.struct(
            epoch_ms("o_orderdate").alias("ts"),
            F.col("o_totalprice").alias("value"),
            F.lit(0).alias("interval"),
            F.lit("USD").alias("valueUnit"),
        )
    )
    second = F.to_json(
        F.struct(
            (epoch_ms("o_orderdate") + DAY_MS).alias("ts"),
            (F.col("o_orderkey").cast("double") + 0.5).alias("value"),
        )
    )
    between = F.lit(', 3, null, "x", [1, {"ts": 1}], ' if junk else ", ")
    body = F.concat(
        F.lit('{"id": '), "o_custkey", F.lit(', "name": "n", "ticker": "t'), "o_custkey",
        F.lit('", "insights": {"stock_price": ['), first, between, second, F.lit("]}}"),
    )
    return orders.select("o_orderkey", body.alias("body"))


ORDER_POINTS = """
points AS (
  SELECT o_custkey AS company_id, 'T' || o_custkey AS ticker, epoch_us(o_orderdate) // 1000 AS ts,
         o_totalprice AS value, 0::BIGINT AS "interval", 'USD' AS "valueUnit", 0::BIGINT AS pos
  FROM orders
  UNION ALL
  SELECT o_custkey, 'T' || o_custkey, epoch_us(o_orderdate) // 1000 + 86400000,
         o_orderkey::DOUBLE + 0.5, NULL, NULL, 1
  FROM orders
)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed payload per customer.

    A negative balance stands for a response of the wrong shape, segment MACHINERY for an explicit
    null name, BUILDING for a document with most fields absent or null.
    """
    customer = table(spark, sf_dir, "customer")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    head = F.concat(F.lit('[{"result":{"data":{"json":{"company":{"id":'), key, F.lit(","))
    tail = F.lit("}}}}}]")
    points = F.concat(
        F.lit('"insights":{"stock_price":[{"ts":'), key * DAY_MS, F.lit(',"value":'), "c_acctbal",
        F.lit(',"interval":0,"valueUnit":"USD"},7]}'),
    )
    full = F.concat(
        F.lit('"name":"'), "c_name", F.lit('","ticker":" t'), key, F.lit('","sector":"'), segment,
        F.lit('","indices":["'), segment, F.lit('"],"aggregations":{"acctbal":'), "c_acctbal",
        F.lit("},"), points,
    )
    nameless = F.concat(F.lit('"name":null,'), points)
    sparse = F.lit('"indices":null,"exchanges":0,"aggregations":null,"insights":{}')
    payload = F.when(F.col("c_acctbal") < 0, F.concat(F.lit('{"error":'), key, F.lit("}"))).otherwise(
        F.concat(
            head,
            F.when(segment == "MACHINERY", nameless).when(segment == "BUILDING", sparse).otherwise(full),
            tail,
        )
    )
    return customer.select(ticker("c_custkey").alias("ticker"), payload.alias("payload"))


#: What ingesting those responses must give.
INGESTED = """
ingested AS (
  SELECT 'T' || c_custkey AS requested, c_custkey + 1 AS id, c_name AS name,
         'T' || c_custkey AS ticker,
         CASE WHEN c_acctbal < 0 THEN 'Unexpected response shape for T' || c_custkey
              WHEN c_mktsegment = 'MACHINERY' THEN 'name: not a valid string' END AS error,
         c_mktsegment <> 'BUILDING' AS is_full, c_mktsegment AS segment, c_acctbal AS acctbal,
         c_custkey * 86400000 AS ts
  FROM customer
)"""
