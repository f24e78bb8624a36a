"""Company and price data pipeline on PySpark DataFrames."""

__version__ = "0.1.0"
