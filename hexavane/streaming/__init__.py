"""Structured Streaming into collections."""

from .ingest import ingest

__all__ = ["ingest"]
