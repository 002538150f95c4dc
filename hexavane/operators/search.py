"""Exact nearest rows by dot product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidTopK
from ..functions.scoring import dot_f32_lanes, dot_f64, fold_dot, literal_vector
from ..shipping import ship

_MAX_LIMIT = 2**31 - 1
#: Queries that are multiplied with a batch of rows at once.
_QUERIES = 256


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise InvalidTopK(f"k must be at least 1, got {k!r}")
    return min(k, _MAX_LIMIT)


def search(df: DataFrame, row_id: str, vector: str, query, k: int, *, where: Column | None = None, score_mode: str = "f64", score: str = "score") -> DataFrame:
    """The k rows of the largest dot product, best first, ties by smaller id; all columns of ``df`` and the score.

    A predicate filters before the ranking, so it reaches the scan. Plans as TakeOrderedAndProject: every task keeps k
    rows, only those travel. ``query`` is a list of numbers or a Column; rows with a null or wrongly sized vector cannot
    score and are left out.
    """
    k = check_k(k)
    source = df if where is None else df.where(where)
    if isinstance(query, Column):
        value = dot_f64(F.col(vector), query)
    elif score_mode == "f64":
        source = source.where(F.size(vector) == len(list(query)))
        value = dot_f64(F.col(vector), literal_vector(query))
    elif score_mode == "f32_lane":
        source = source.where(F.size(vector) == len(list(query)))
        value = dot_f32_lanes(F.col(vector), query).cast("double")
    else:
        raise ValueError(f"no score mode {score_mode!r}")
    return source.withColumn(score, value).where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(row_id)).limit(k)


def _finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids and vectors by length, streamed to the driver in blocks of ``block_bytes``."""
    held: dict[int, tuple[list, list]] = {}
    size = 0
    for r in queries.toLocalIterator():
        ids, vectors = held.setdefault(len(r["v"]), ([], []))
        ids.append(r["query_id"])
        vectors.append(r["v"])
        size += 8 * (len(r["v"]) + 1)
        if size >= block_bytes:
            yield {d: (np.array(i, np.int64), np.array(v, np.float64)) for d, (i, v) in held.items()}
            held, size = {}, 0
    if held:
        yield {d: (np.array(i, np.int64), np.array(v, np.float64)) for d, (i, v) in held.items()}


class Best:
    """The k best rows of each of a block of queries, so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.length = np.linalg.norm(queries, axis=1)
        self.edge = np.full(len(queries), -np.inf)  # score that a row must reach
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(queries)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """A matrix product tells which rows may be among the best; their scores are added up again in a fixed order."""
        error = 1e-12 * x.shape[1] * self.length * np.linalg.norm(x, axis=1).max(initial=0.0)
        for at in range(0, len(self.queries), _QUERIES):
            rough = self.queries[at : at + _QUERIES] @ x.T
            low = self.edge[at : at + _QUERIES]
            if len(ids) > self.k:
                low = np.maximum(low, -np.partition(-rough, self.k - 1, axis=1)[:, self.k - 1])
            may = rough >= (low - error[at : at + _QUERIES])[:, None]
            for j in np.flatnonzero(may.any(1)).tolist():
                self._merge(at + j, ids[may[j]], fold_dot(x[may[j]], self.queries[at + j]))

    def _merge(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[j], ids]), np.concatenate([self.scores[j], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[j], self.scores[j] = ids[best], scores[best]
        if len(best) == self.k:
            self.edge[j] = scores[best[-1]]


def batch_search(df: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, *, block_bytes: int = 32 << 20) -> DataFrame:
    """Extension: the k best rows for each of many queries: query_id, id, score, rank.

    The stated query set meets all rows, in blocks of at most ``block_bytes`` that are broadcast, one pass over the rows for
    each block. A task multiplies its rows with the block in Arrow batches and keeps k rows for each query; only those are
    shuffled. Rows and queries whose vector is null, of another length or holds a component that is not finite do not score.
    Ids are whole numbers. Rows that share a query id are ranked together.
    """
    k = check_k(k)
    spark = df.sparkSession
    ship(spark)
    schema = "query_id bigint, id bigint, score double"
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where("query_id IS NOT NULL").where(_finite(F.col("v")))
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL").where(_finite(F.col("v")))

    def one(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {d: Best(x, k) for d, (_, x) in sent.value.items()}
            for batch in batches:
                size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for d in np.unique(size).tolist():
                    if d in best:
                        some = batch.filter(pa.array(size == d))
                        best[d].add(some.column(0).to_numpy(), some.column(1).flatten().to_numpy().reshape(-1, d).astype(np.float64))
            for d, (ids, _) in sent.value.items():
                names = np.repeat(ids, [len(x) for x in best[d].ids])
                yield pa.record_batch([pa.array(names), pa.array(np.concatenate(best[d].ids)), pa.array(np.concatenate(best[d].scores))], ["query_id", "id", "score"])

        return rows.mapInArrow(run, schema)

    parts = [one(spark.sparkContext.broadcast(block)) for block in _query_blocks(q, block_bytes)]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
