"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node of its component.

    Each round only takes minima by node and joins them back. Minima of all neighbours are written before they are joined:
    both sides of the join are then plain shuffles, of which Spark splits a node with a third of all edges over many tasks (it
    cannot where the minimum is taken in the same stage). Rounds are written out: lineage stays short, and a lost executor repeats one
    step. The number of rounds is logarithmic in the size of a component.
    """
    e = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = materialize(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # the larger end of an edge: few smaller ones are left
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "edges")
        drop(e, low, large)
        e, before = now, state
        state = _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def roots(parents: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``parents`` (u, v), where each u is there once and v < u: label is the node that has no
    parent above u. Each round every node takes its parent's parent, so depth halves."""
    now = materialize(parents.select("u", "v"), "parents")
    for _ in range(most_rounds):
        up = now.select(F.col("u").alias("w"), F.col("v").alias("x"))
        moved = materialize(now.join(up.hint("merge"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("x", "v").alias("v"), F.col("x").isNotNull().alias("moved")), "parents")
        drop(now)
        now = moved
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"parents did not settle in {most_rounds} rounds")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops)


def _state(e: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]
