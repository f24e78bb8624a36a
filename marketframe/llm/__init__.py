"""Operators for large text corpora: packing, filters, extraction, scans, search, deduplication.

Every operator takes and returns DataFrames. ``queries`` registers one query per operator over the
given tables; nothing else in the library imports this subpackage.
"""
