"""Typed vector collections and exact nearest-row search on Spark."""

from .database import Database
from .schema import FLOAT, INT, TEXT, VECTOR, Collection, Column

__all__ = ["FLOAT", "INT", "TEXT", "VECTOR", "Collection", "Column", "Database"]
