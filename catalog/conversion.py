"""Conversion of company documents into every output format."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.plans import convert
from marketframe.workspace import fresh_path

from .registration import query
from .shapes import customer_companies
from .tables import CUSTOMER_COMPANIES, event_prices


@query(
    "snk_convert_counts",
    """SELECT count(*) AS converted, count(*) AS company_rows,
       (SELECT count(*) FROM events)
         + count(*) FILTER (c_custkey NOT IN (SELECT user_id FROM events)) AS price_rows
FROM customer""",
)
def _(spark, sf_dir):
    return convert(
        customer_companies(spark, sf_dir), fresh_path(spark, "convert"), event_prices(spark, sf_dir)
    )


@query(
    "snk_sql_rows",
    f"""WITH {CUSTOMER_COMPANIES}
SELECT 'INSERT INTO "stock_price_insights" ("company_id", "ticker", "ts", "value", "interval", "valueUnit") VALUES ('
       || id || ', ''' || ticker || ''', ' || ts || ', ' || value::VARCHAR || ', 0, ''USD'');' AS statement
FROM companies""",
)
def _(spark, sf_dir):
    """The price rows of the exported SQL script, read back as text."""
    root = fresh_path(spark, "convert")
    convert(customer_companies(spark, sf_dir), root, formats=("sql",))
    rows = spark.read.text(f"{root}/sql/stock_price_insights/rows")
    return rows.select(F.col("value").alias("statement"))
