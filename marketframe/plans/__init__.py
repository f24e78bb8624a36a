"""Whole runs: ingest, convert, update, set-up."""

from .convert import convert, convert_counts
from .ingest import Ingested, ingest, normalize_companies, write_ingested
from .lifecycle import setup, update, update_report
from .publishing import manifest, publish, published_inventory, read_published, update_published, write_run

__all__ = [
    "Ingested",
    "convert",
    "convert_counts",
    "ingest",
    "manifest",
    "normalize_companies",
    "publish",
    "published_inventory",
    "read_published",
    "setup",
    "update",
    "update_published",
    "update_report",
    "write_ingested",
    "write_run",
]
