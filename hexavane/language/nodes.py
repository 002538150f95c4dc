"""Syntax trees. Values are plain Python: int, float, str, or a tuple of float32-rounded floats."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str  # VECTOR, TEXT, INT or FLOAT
    dim: int | None = None


@dataclass(frozen=True)
class Create:
    name: str
    columns: tuple[ColumnDef, ...]
    options: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Insert:
    collection: str
    columns: tuple[str, ...]
    values: tuple


@dataclass(frozen=True)
class Select:
    collection: str
    columns: tuple[str, ...] | None  # None: *


@dataclass(frozen=True)
class Search:
    collection: str
    k: int
    query: tuple[float, ...]
    returning: tuple[str, ...] | None


Statement = Create | Insert | Select | Search
