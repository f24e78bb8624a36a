"""Writing company and price tables as JSON, CSV, Parquet and SQL."""

from .files import write_csv, write_json, write_mapping, write_parquet, write_table
from .periods import write_price_periods
from .sql import insert_statements, price_sql_schema, sql_schema, sql_script_head, write_sql

__all__ = [
    "insert_statements",
    "price_sql_schema",
    "sql_schema",
    "sql_script_head",
    "write_csv",
    "write_json",
    "write_mapping",
    "write_parquet",
    "write_price_periods",
    "write_sql",
    "write_table",
]
