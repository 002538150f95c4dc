"""Nearest vectors against all products."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexavane.llm import neighbours as N

COLUMNS = "vec_id bigint, embedding array<float>, rank string, score string, query_id string, number string, segment string"


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(*r, "r", "s", "q", "n", "g") for r in rows], columns)


def wanted(x, ids, q, own, k=20):
    score = N.inner(x, q)
    return [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score)) if ids[i] != own][:k]


@pytest.mark.parametrize("kind", ["spread", "same", "double"])
def test_odd_rows_and_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32) * rng.uniform(0.2, 3, (900, 1)).astype(np.float32)
    if kind == "same":
        x[200:600] = x[200]
    odd = [(5, x[5].tolist()), (7, x[8].tolist()), (2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [math.inf] * 16), (2004, [1.0]), (None, x[1].tolist()), (2005, [None] * 16), (2006, [])]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd, COLUMNS.replace("array<float>", "array<double>") if kind == "double" else COLUMNS)
    got = collections.defaultdict(list)
    for r in N.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    every, ids, right = np.concatenate([x, x[8:9]]).astype(float), np.array([*range(900), 7]), 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        best = wanted(every, ids, every[q], q)
        right += len(set(found) & set(best))
        assert len(found) == 20 and found == sorted(found, key=lambda t: (-t[1], t[0])) and all(any(math.isclose(s, N.inner(every[[k]], every[q])[0], abs_tol=0) for k in np.flatnonzero(ids == i)) for i, s in found)
    assert right >= 0.9 * 20 * len(got)


def test_few_rows(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in N.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1.0)]
    assert N.nearest(df.limit(0), F.lit(True)).count() == 0 and N.nearest(df, F.lit(False)).count() == 0
    same = frame(spark, [(i, [0.6, 0.8]) for i in range(50)])
    assert all(r["rank"] >= 1 for r in N.nearest(same, F.col("vec_id") < 3).collect())
    assert {(r["query_id"], r["vec_id"]) for r in N.nearest(same, F.col("vec_id") == 3, k=2).collect()} == {(3, 0), (3, 1)}


def opened(spark, x, k=20):
    """Plan, segments, blocks and the first round's product for the rows ``x``, every 20th a query."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id bigint, v array<float>")
    plan = N.Plan(x.shape[1], False, N.directions(x.shape[1] + 1, 128, 23), N.landmarks_of(x[:4096], N.LANDMARKS), 1.6, N.threshold(128, 1.6, 1.2), k)
    t = N.rounds_of(x[:4096], len(x), k)[0]
    segments = N.materialize(N.build_index(df, plan, len(x)), "segments")
    blocks, count = N.blocks_of(df.where("vec_id % 20 = 0"), plan, len(x) // 20)
    return plan, segments, blocks, count, t


def test_candidates_are_few(spark):
    """Even without any structure in the vectors most are never multiplied, and fewer the more there are."""
    shares = []
    for n in (2000, 16000):
        x = N.unit(np.random.default_rng(n).normal(size=(n, 64)))
        plan, segments, _, _, t = opened(spark, x)
        held = total = 0
        for r in segments.collect():
            s = N.Segment(r["norm"], np.frombuffer(r["high"]), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float32).reshape(-1, 64), np.frombuffer(r["cells"], np.uint8).reshape(128, -1), np.frombuffer(r["edges"]).reshape(128, -1))
            mask = s.candidates(x[::200] @ plan.axes[:64], t, plan)
            held, total = held + mask.sum(), total + mask.size
            far = np.abs(((s.vectors / s.norm) @ plan.axes[:64])[:, None, :] - (x[::200] @ plan.axes[:64])[None]) <= N.width_of(t, s.norm, 1.6)
            assert not ((far.sum(2) >= plan.least + 6).T & ~mask).any()  # cells round windows outwards; the last coordinate is left out here
        shares.append(held / total)
    assert shares[0] < 0.25 and shares[1] < 0.5 * shares[0]


def test_segments_are_ruled_out(spark):
    """Vectors around six far points: a block of queries meets few segments, and no neighbour is lost by it."""
    rng = np.random.default_rng(6)
    x = N.unit(N.unit(rng.normal(size=(6, 32)))[rng.integers(0, 6, 12000)] + 0.03 * rng.normal(size=(12000, 32)))
    plan, segments, blocks, count, t = opened(spark, x)
    met = N.meetings(segments, blocks, count, plan, t).count()
    assert 0 < met < 0.5 * count * segments.count()
    found = collections.defaultdict(set)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for r in N.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    right = sum(len(found[q] & {i for i, _ in wanted(x, np.arange(len(x)), x[q], q)}) for q in range(0, 12000, 100))
    assert right >= 0.9 * 20 * 120


def test_norms_rule_out_segments(spark):
    x = np.random.default_rng(7).normal(size=(8000, 24)) * np.repeat([0.01, 5.0], 4000)[:, None]
    plan, segments, blocks, count, t = opened(spark, x)
    assert N.meetings(segments, blocks, count, plan, t).count() < 0.8 * count * segments.count()
