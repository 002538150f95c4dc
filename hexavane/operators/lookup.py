"""Predicates on one scalar column. Types are checked before Spark could coerce them; the result is a Column for ``where``."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..schema import TEXT, Column, check_scalar

_COMPARE = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def lookup_eq(column: Column, value, physical: str | None = None) -> SparkColumn:
    """Exact equality; +0.0 and -0.0 are one key; a NaN probe or a probe of another type raises."""
    return F.col(physical or column.name) == F.lit(check_scalar(column, value))


def lookup_range(column: Column, op: str, value, physical: str | None = None) -> SparkColumn:
    """One-sided range. On TEXT it is empty for any probe."""
    if op not in _COMPARE:
        raise ValueError(f"no comparison {op!r}")
    if column.kind == TEXT:
        return F.lit(False)
    return _COMPARE[op](F.col(physical or column.name), F.lit(check_scalar(column, value)))
