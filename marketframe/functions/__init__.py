"""Column functions: plain built-in expressions, no Python workers."""

from .text import (
    canonical_ticker,
    json_string,
    json_text,
    lax_integer,
    number_text,
    sql_literal,
)
from .variants import kind_of, lax_integer_of

__all__ = [
    "canonical_ticker",
    "json_string",
    "json_text",
    "kind_of",
    "lax_integer",
    "lax_integer_of",
    "number_text",
    "sql_literal",
]
