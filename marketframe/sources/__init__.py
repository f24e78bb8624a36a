"""Reading company documents, price tables, the ticker registry and landed API responses."""

from .arrays import array_elements
from .documents import (
    Quarantine,
    document_bodies,
    document_lines,
    parsed_documents,
    quarantined,
    read_companies,
    read_document_text,
    read_prices,
    shredded,
    with_path_ticker,
)
from .inventory import inventory, listed_tickers
from .periods import needed_periods, period_counts, read_recent_prices
from .registry import mapping_from_entries, read_mapping, read_mapping_entries
from .responses import unwrap_responses

__all__ = [
    "Quarantine",
    "array_elements",
    "document_bodies",
    "document_lines",
    "inventory",
    "listed_tickers",
    "mapping_from_entries",
    "needed_periods",
    "parsed_documents",
    "period_counts",
    "quarantined",
    "read_companies",
    "read_document_text",
    "read_mapping",
    "read_mapping_entries",
    "read_prices",
    "read_recent_prices",
    "shredded",
    "unwrap_responses",
    "with_path_ticker",
]
