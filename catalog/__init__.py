"""Registered queries over the given tables, each with the SQL that must agree with it."""

from . import conversion, lifecycle, measures, records, shapes, storage
from .registration import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "conversion", "lifecycle", "measures", "records", "shapes", "storage"]
