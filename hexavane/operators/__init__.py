"""Operators over any DataFrame with a row-id column; collections and plain tables use the same ones."""

from .lookup import lookup_eq, lookup_range
from .rows import fetch_rows, high_water, live_rows, scan_over, vector_at
from .search import batch_search, search

__all__ = ["batch_search", "fetch_rows", "high_water", "live_rows", "lookup_eq", "lookup_range", "scan_over", "search", "vector_at"]
