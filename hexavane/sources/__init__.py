"""Where rows live: the versioned store of a database, and external tables read as collections."""

from .external import external_rows
from .store import Store

__all__ = ["Store", "external_rows"]
