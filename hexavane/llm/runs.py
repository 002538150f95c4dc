"""Groups of a sorted stream, one at a time: what a grouped map does, without a call for each group from the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_runs(df: DataFrame, keys: list[str], each: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str, *, then: list[str] | None = None) -> DataFrame:
    """Deal ``df`` by ``keys``, sort, and call ``each(key values, rows)`` for every group. A group must fit a task's memory;
    callers bound it. ``then``: further sort columns inside a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in _spans(batch, keys):
                key = tuple(batch.column(batch.schema.get_field_index(k))[a].as_py() for k in keys)
                if held and key != now:
                    yield from each(now, pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from each(now, pa.Table.from_batches(held))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *(then or []))
    return dealt.mapInArrow(run, schema)


def _spans(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """Row ranges of equal keys."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(change).tolist()
    return list(zip(at, [*at[1:], batch.num_rows], strict=True))
