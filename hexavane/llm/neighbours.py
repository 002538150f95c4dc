"""Approximate nearest vectors by collision counting over single-projection sorted arrays, with virtual rehashing.

Inner products become distances by one more coordinate: the vectors of a segment are divided by the largest norm among them
and completed to length one, queries are normalised, so that distance ** 2 = 2 - 2 * product / norm. A segment of the index
holds its vectors and, for each of ``projections`` directions, the sorted projections, cut into 256 cells of equal count, and
the cell of each vector. A query opens a window around its own projection in every array; only vectors that lie in at least
a threshold of the windows are candidates and are multiplied.

The search runs in rounds of falling products t. A round opens windows of ``ratio`` times the distance that t stands for: a
vector with that product lies in each with probability 2 * Phi(ratio) - 1, and the threshold is ``slack`` standard deviations
below the count that follows, so vectors with larger products pass it more surely still. A query with k verified products of t
or more is done, as its true neighbours lie above t too; the others go to the next round, where the same arrays are opened
wider: virtual rehashing. The last round opens them all the way.

Directions come in orthogonal sets, which makes counts follow distances more closely than independent ones. Vectors are dealt
to segments by norm and nearest landmark, so a segment covers a short range of many projections: a block of queries whose
windows miss these ranges at too many projections, or whose t is beyond a segment's largest norm, never meets that segment,
and loses no candidate by it. The landmarks and the first t are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .scratch import materialize

CELLS = 256
#: Rows at which a segment or a block of queries ends where its landmark does, and at which it ends in any case.
SEGMENT_ROWS = (1024, 4096)
QUERY_ROWS = (64, 256)
LANDMARKS = 64
SAMPLE_BYTES = 16 << 20


@dataclass(frozen=True)
class Plan:
    """What a search has fitted beforehand; of bounded size, sent along with the tasks. ``wide``: stored as doubles."""

    dim: int
    wide: bool
    axes: np.ndarray
    landmarks: np.ndarray
    ratio: float
    least: int
    k: int

    def kind(self) -> type:
        return np.float64 if self.wide else np.float32


def usable(vector: Column) -> Column:
    """Not null or empty, only finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random directions in ``dim`` dimensions as columns, orthogonal within each set of ``dim``, scaled so that a
    projection of a difference has the variance of a normal one."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sets = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] * math.sqrt(dim) for _ in range(-(-count // dim))]
    return np.concatenate(sets, 1)[:, :count]


def threshold(projections: int, ratio: float, slack: float) -> int:
    """Collisions that a vector at exactly a round's distance falls short of only by ``slack`` deviations. Orthogonal sets
    leave about 0.6 of the deviation of independent directions (measured)."""
    chance = 2 * NormalDist().cdf(ratio) - 1
    return max(1, math.floor(projections * chance - slack * 0.6 * math.sqrt(projections * chance * (1 - chance))))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def landmarks_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions around which the sample gathers, each followed by its nearest of the rest; they only order the index."""
    points = unit(sample)
    at = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)]
    for _ in range(5):
        near = (points @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, points)
        some = np.linalg.norm(sums, axis=1) > 1e-9
        at[some] = unit(sums[some])
    chain, left = [0], list(range(1, len(at)))
    while left:
        chain.append(left.pop(int((at[left] @ at[chain[-1]]).argmax())))
    return at[chain]


def rounds_of(sample: np.ndarray, rows: int, k: int) -> list[float | None]:
    """Falling products, per unit of the query's length; None, the last, stands for all vectors. The first is what four of
    five sample vectors reach at the rank in the sample that answers to rank k among all ``rows``."""
    rank = max(1, round(k * len(sample) / rows))
    if len(sample) <= rank or rows <= k:
        return [None]
    some = sample[: max(1, min(256, len(sample)))]
    product = unit(some) @ sample.T
    product[np.arange(len(some)), np.arange(len(some))] = -np.inf
    reached = -np.partition(-product, rank - 1, axis=1)[:, rank - 1]
    norm = float(np.linalg.norm(sample, axis=1).max())
    out: list[float | None] = [float(np.quantile(reached, 0.2)), float(np.quantile(reached, 0.02))]
    while (spread := 1.6 * max(2 - 2 * out[-1] / norm, 0.05)) < 3.5:
        out.append(norm * (1 - spread / 2))
    return [*sorted(set(out), reverse=True), None]


def _deal(vectors: DataFrame, plan: Plan) -> DataFrame:
    """``vec_id`` and ``v`` with ``band`` (of the norm, in eighths of an octave) and ``near`` (number of the nearest landmark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, plan.dim).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            band = np.floor(8 * np.log2(norm) + 0.5).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            near = (x @ plan.landmarks.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(band), pa.array(near)], ["vec_id", "v", "band", "near"])

    return vectors.select("vec_id", "v").mapInArrow(run, T.StructType([*vectors.select("vec_id", "v").schema, T.StructField("band", T.IntegerType()), T.StructField("near", T.IntegerType())]))


def _groups(batches: Iterator[pa.RecordBatch], plan: Plan, rows: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of consecutive rows, cut by ``rows``."""
    ids, parts, held, now = [], [], 0, None
    for batch in batches:
        names, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, plan.dim)
        place = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
        cut = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(names)], strict=True):
            if a == b:
                continue
            here = tuple(place[a].tolist())
            if held >= rows[0] and here != now:
                yield np.concatenate(ids), np.concatenate(parts)
                ids, parts, held = [], [], 0
            now = here
            while a < b:
                to = min(b, a + rows[1] - held)
                ids.append(names[a:to])
                parts.append(x[a:to])
                held += to - a
                a = to
                if held >= rows[1]:
                    yield np.concatenate(ids), np.concatenate(parts)
                    ids, parts, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(parts)


SEGMENT = "segment string, norm double, low binary, high binary, ids binary, vectors binary, cells binary, edges binary"


def build_index(vectors: DataFrame, plan: Plan, rows: int) -> DataFrame:
    """Segments of ``vectors`` (vec_id and v): vectors, the cell of each vector by projection, where cells begin, and the
    range of each projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _groups(batches, plan, SEGMENT_ROWS):
            wide = x.astype(np.float64)
            norm = float(np.linalg.norm(wide, axis=1).max())
            scaled = wide / norm
            rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1, keepdims=True)))
            p = (np.concatenate([scaled, rest], 1) @ plan.axes).T
            order = np.argsort(p, axis=1, kind="stable")
            values, n = np.take_along_axis(p, order, 1), len(ids)
            some = min(CELLS, n)
            cell = (np.arange(n) * some // n).astype(np.uint8)
            cells = np.empty(order.shape, np.uint8)
            np.put_along_axis(cells, order, np.broadcast_to(cell, order.shape), 1)
            begin = np.searchsorted(cell, np.arange(some))
            row = [uuid.uuid4().hex, norm, values[:, 0], values[:, -1], ids.astype(np.int64), x.astype(plan.kind()), cells, values[:, begin]]
            kinds = [pa.string(), pa.float64(), *[pa.binary()] * 6]
            yield pa.record_batch([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SEGMENT.split(", ")])

    dealt = _deal(vectors, plan).repartitionByRange(max(1, -(-rows // (4 * SEGMENT_ROWS[1]))), "band", "near", F.xxhash64("vec_id"))
    return dealt.sortWithinPartitions("band", "near", F.xxhash64("vec_id")).mapInArrow(run, SEGMENT)


def blocks_of(queries: DataFrame, plan: Plan, rows: int) -> tuple[DataFrame, int]:
    """number, q_low, q_high (ranges of the block's projections), query_ids, queries; and how many blocks there are. Only a
    count for each writing task passes through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for ids, q in _groups(batches, plan, QUERY_ROWS):
            p = unit(q.astype(np.float64)) @ plan.axes[: plan.dim]
            row = [part, at, p.min(0), p.max(0), ids.astype(np.int64), q.astype(np.float64)]
            yield pa.record_batch([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], t) for v, t in zip(row, [pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], ["part", "at", "q_low", "q_high", "query_ids", "queries"])
            at += 1

    dealt = _deal(queries, plan).repartitionByRange(max(1, -(-rows // (4 * QUERY_ROWS[1]))), "near", "vec_id").sortWithinPartitions("near", "vec_id")
    made = materialize(dealt.mapInArrow(run, "part int, at int, q_low binary, q_high binary, query_ids binary, queries binary"), "blocks")
    total, base = 0, []
    for r in made.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        base.append((r["part"], total))
        total += r["n"]
    first = queries.sparkSession.createDataFrame(base, "part int, base int")
    return made.join(F.broadcast(first), "part").select((F.col("base") + F.col("at")).alias("number"), "q_low", "q_high", "query_ids", "queries"), total


def width_of(t: float, norm: float, ratio: float) -> float:
    """Half a window: ``ratio`` times the distance of a vector with product ``t``; a little more, for rounding."""
    return ratio * math.sqrt(max(0.0, 2 - 2 * t / norm) + 1e-9)


def meetings(segments: DataFrame, blocks: DataFrame, count: int, plan: Plan, t: float | None) -> DataFrame:
    """(segment, number): segments with the blocks that may find a candidate in them. Only ranges are compared here."""
    zones = segments.select("segment", "norm", "low", "high").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    both = zones.join(blocks.select("number", "q_low", "q_high"), "number").select("segment", "number", "norm", "low", "high", "q_low", "q_high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column(2).to_numpy()
            low, high, q_low, q_high = (np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(len(norm), -1) for c in (3, 4, 5, 6))
            width = np.array([math.inf if t is None else width_of(t, x, plan.ratio) for x in norm])[:, None]
            reach = ((q_low - width <= high) & (q_high + width >= low)).sum(1) >= plan.least
            if t is not None:
                reach &= t <= norm * (1 + 1e-9)
            yield batch.select([0, 1]).filter(pa.array(reach))

    return both.mapInArrow(run, "segment string, number int")


@dataclass
class Segment:
    """One segment, opened for queries."""

    norm: float
    high: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    cells: np.ndarray
    edges: np.ndarray

    def candidates(self, at: np.ndarray, t: float | None, plan: Plan) -> np.ndarray:
        """For each query (row of projections) a mask of the vectors that collide with it at ``plan.least`` projections."""
        n, m = len(self.ids), plan.axes.shape[1]
        if t is None:
            return np.ones((len(at), n), bool)
        width = width_of(t, self.norm, plan.ratio)
        low = np.stack([np.searchsorted(self.edges[j], at[:, j] - width, "right") for j in range(m)], 1) - 1
        high = np.stack([np.searchsorted(self.edges[j], at[:, j] + width, "right") for j in range(m)], 1) - 1
        none = (high < 0) | (at - width > self.high)
        low = np.maximum(low, 0)
        begin, span = low.astype(np.uint8), np.maximum(high - low, 0).astype(np.uint8)
        out = np.empty((len(at), n), bool)
        for a in range(0, len(at), 32):
            rows = slice(a, a + 32)
            count = np.zeros((len(at[rows]), n), np.uint8 if m < 256 else np.uint16)
            for j in range(m):
                inside = (self.cells[j] - begin[rows, j][:, None]) <= span[rows, j][:, None]
                if none[rows, j].any():
                    inside &= ~none[rows, j][:, None]
                count += inside.view(np.uint8)
            out[rows] = count >= plan.least
        return out

    def search(self, query_ids: np.ndarray, q: np.ndarray, t: float | None, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and products: for each query the k best candidates with a product of t or more."""
        length = np.linalg.norm(q, axis=1)
        near = self.candidates((q / length[:, None]) @ plan.axes[: plan.dim], t, plan)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for j in range(len(q)):
            some = np.flatnonzero(near[j])
            some = some[self.ids[some] != query_ids[j]]
            if not len(some):
                continue
            rough = self.vectors[some].astype(np.float64, copy=False) @ q[j]
            error = 1e-9 * length[j] * self.norm
            edge = -math.inf if t is None else t * length[j] - error
            if len(some) > plan.k:
                edge = max(edge, -np.partition(-rough, plan.k - 1)[plan.k - 1] - error)
            some = some[rough >= edge]
            exact = inner(self.vectors[some], q[j])
            best = np.lexsort((self.ids[some], -exact))[: plan.k]
            if t is not None:
                best = best[exact[best] >= t * length[j]]
            out[0].append(np.full(len(best), query_ids[j]))
            out[1].append(self.ids[some][best])
            out[2].append(exact[best])
        return tuple(np.concatenate(x) for x in out)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products added up from the first component to the last in double precision."""
    total = np.zeros(len(x))
    for d in range(len(q)):
        total += x[:, d].astype(np.float64) * q[d]
    return total


def search_round(segments: DataFrame, blocks: DataFrame, count: int, pieces: int, plan: Plan, t: float | None) -> DataFrame:
    """query_id, vec_id, score of one round. Blocks travel to the segments they meet; a segment travels once."""
    met = meetings(segments, blocks, count, plan, t)
    empty = F.lit(None).cast("binary")
    ask = met.join(blocks.select("number", "query_ids", "queries"), "number")
    one = segments.select("segment", F.lit(-1).alias("number"), "norm", "high", "ids", "vectors", "cells", "edges", empty.alias("query_ids"), empty.alias("queries"))
    two = ask.select("segment", "number", F.lit(None).cast("double").alias("norm"), *[empty.alias(c) for c in ("high", "ids", "vectors", "cells", "edges")], "query_ids", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, m = None, None, plan.axes.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = lambda c: batch.column(c)[i].as_buffer()  # noqa: E731, B023
                if batch.column(1)[i].as_py() < 0:
                    name = batch.column(0)[i].as_py()
                    now = Segment(batch.column(2)[i].as_py(), np.frombuffer(raw(3)), np.frombuffer(raw(4), np.int64), np.frombuffer(raw(5), plan.kind()).reshape(-1, plan.dim), np.frombuffer(raw(6), np.uint8).reshape(m, -1), np.frombuffer(raw(7)).reshape(m, -1))
                    continue
                if batch.column(0)[i].as_py() != name:
                    raise ValueError("a block of queries came without its segment")
                found = now.search(np.frombuffer(raw(8), np.int64), np.frombuffer(raw(9)).reshape(-1, plan.dim), t, plan)
                yield pa.record_batch([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    dealt = one.unionByName(two).repartition(pieces, "segment").sortWithinPartitions("segment", "number")
    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, projections: int = 128, ratio: float = 1.6, slack: float = 1.2, sample: int = 4096, seed: int = 23, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` selects its k nearest other rows found, nearest first by
    inner product, ties to the smaller vec_id; all candidates if there are fewer.

    Null, empty, zero and non-finite vectors, and rows without vec_id, take no part, nor do vectors of another length than
    most have (of equals the shorter). Rows that repeat both id and vector count once; of rows that repeat an id with another
    vector each is a candidate, and the query is the smallest vector of them. A row never finds its own vec_id. An empty
    table gives no rows; other columns are ignored, whatever their names. ``sample`` bounds the rows the search is fitted on
    (and their bytes ``SAMPLE_BYTES``).
    """
    spark = vectors.sparkSession
    ship(spark)
    wide = not isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    v = F.col(vector).cast("array<double>" if wide else "array<float>")
    clean = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"), is_query.alias("is_query"))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    dims = clean.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["dim"]
    fit = materialize(clean.where(F.size("v") == dim).groupBy("vec_id", "v").agg(F.max("is_query").alias("is_query")), "vectors")
    rows = fit.count()
    most = max(64, min(sample, SAMPLE_BYTES // (8 * dim)))
    picked = fit.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    known = np.array(picked.column("v").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, dim)
    plan = Plan(dim, wide, directions(dim + 1, projections, seed), landmarks_of(known, LANDMARKS), ratio, threshold(projections, ratio, slack), k)
    segments = materialize(build_index(fit, plan, rows), "segments")
    pieces = segments.count()
    asked = materialize(fit.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    open_, parts = asked.count(), []
    for t in rounds_of(known, rows, k):
        if not open_:
            break
        blocks, count = blocks_of(asked, plan, open_)
        found = materialize(search_round(segments, blocks, count, pieces, plan, t), "found")
        if t is None:
            parts.append(found)
            break
        done = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        done = materialize(done, "done")
        parts.append(found.join(done, "query_id", "left_semi"))
        asked = materialize(asked.join(done, F.col("vec_id") == F.col("query_id"), "left_anti"), "queries")
        open_ = asked.count()
    if not parts:
        return spark.createDataFrame([], schema)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
