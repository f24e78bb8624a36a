"""The query registry, and rounding that is the same on both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Two-digit prices divided by small counts often lie exactly halfway between two roundings, where
# the last bit of a sum decides. The shift moves the halfway points off such values.
SHIFT = 0.31415926


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value + SHIFT * 10.0**-digits, digits) + F.lit(0.0)


def sql_rounded(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + {SHIFT} * 1e-{digits}, {digits}) + 0.0)"
