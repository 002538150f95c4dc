"""Bound reads to DataFrames. Catalyst does the rest: pruning, pushdown and the top-k operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..operators.search import search
from ..schema import ROW_ID, VECTOR, Collection
from .binder import BoundSearch, BoundSelect, Output

_SCORE = "__score"


def project(df: DataFrame, c: Collection, outputs: tuple[Output, ...]) -> DataFrame:
    source = {"id": ROW_ID, "score": _SCORE}
    return df.select(*[F.col(c.physical(o.label) if o.source == "stored" else source[o.source]).alias(o.label) for o in outputs])


def plan_select(bound: BoundSelect, live: DataFrame, *, allow_vector: bool = False) -> DataFrame:
    """Rows in ascending id. Selecting the vector raises unless ``allow_vector`` (an extension) is set."""
    if not allow_vector and any(bound.collection.column(o.label).kind == VECTOR for o in bound.outputs):
        raise Unsupported("the vector column cannot be selected")
    return project(live.orderBy(ROW_ID), bound.collection, bound.outputs)


def plan_search(bound: BoundSearch, live: DataFrame, *, score_mode: str = "f64") -> DataFrame:
    c = bound.collection
    best = search(live, ROW_ID, c.physical(c.vector.name), list(bound.query), bound.k, score_mode=score_mode, score=_SCORE)
    return project(best, c, bound.outputs)
