"""Dot products as Spark columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot_f64(a: Column, b: Column) -> Column:
    """Left-to-right fold in double precision, on the JVM. Both arrays must have one length: ``zip_with`` pads with null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def fold_dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The same fold over the rows of a matrix, bit for bit."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d].astype(np.float64) * query[d]
    return total


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c for single-precision values, rounded once to single precision.

    The product is exact in double precision. The sum is rounded to odd there, by its exact error, and a value rounded to
    odd with that many spare bits rounds on to what the exact value would round to.
    """
    product, wide = a.astype(np.float64) * b.astype(np.float64), c.astype(np.float64)
    total = product + wide
    part = total - product
    error = (product - (total - part)) + (wide - part)
    even = (total.view(np.int64) & 1) == 0
    off = even & (error != 0) & np.isfinite(total) & np.isfinite(error)
    total = np.where(off, np.nextafter(total, np.where(error > 0, np.inf, -np.inf)), total)
    return total.astype(np.float32)


def lane_dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Eight float32 lanes of fused multiply-add, lanes summed left to right, tail fused into the sum; bit for bit."""
    x, q = rows.astype(np.float32), query.astype(np.float32)
    n, dim = x.shape
    whole = dim - dim % 8
    lanes = np.zeros((n, 8), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, whole, 8):
            lanes = fused(x[:, at : at + 8], np.broadcast_to(q[at : at + 8], (n, 8)), lanes)
        total = np.zeros(n, np.float32)
        for lane in range(8):
            total = total + lanes[:, lane]
        for at in range(whole, dim):
            total = fused(x[:, at], np.full(n, q[at], np.float32), total)
    return total


def dot_f32_lanes(vector: Column, query) -> Column:
    """Single-precision score for parity with a SIMD kernel; Arrow batches, not row by row."""
    ship(SparkSession.getActiveSession())
    q = np.asarray(query, np.float32)

    @F.pandas_udf("float")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(lane_dot(np.stack(v.to_numpy()).astype(np.float32), q) if len(v) else np.zeros(0, np.float32))

    return score(vector)
