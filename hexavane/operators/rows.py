"""Rows by id: liveness, fetch with status, scans in a given order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_rows(rows: DataFrame, deleted: DataFrame, row_id: str) -> DataFrame:
    """Rows without a tombstone. No broadcast hint: tombstones grow with use, so Spark decides by their measured size."""
    return rows.join(deleted.select(row_id), row_id, "left_anti")


def id_table(like: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Positions and ids of a stated id list, in order, repeats included."""
    return like.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos bigint, want bigint")


def scan_over(live: DataFrame, row_id: str, ids: Iterable[int]) -> DataFrame:
    """Live rows of the given ids in the given order; absent ids are skipped, repeats repeat. Adds ``pos``."""
    wanted = id_table(live, ids)
    return wanted.join(live, F.col("want") == F.col(row_id)).drop("want").orderBy("pos")


def fetch_rows(rows: DataFrame, deleted: DataFrame, row_id: str, ids: Iterable[int], columns: list[str]) -> DataFrame:
    """pos, id, status (live, deleted or missing) and the columns, null unless live; one row for each id asked for."""
    wanted = id_table(rows, ids)
    dead = deleted.select(F.col(row_id).alias("__dead")).distinct()
    found = rows.select(F.col(row_id).alias("__found"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    joined = wanted.join(found, F.col("want") == F.col("__found"), "left").join(dead, F.col("want") == F.col("__dead"), "left")
    status = F.when(F.col("__dead").isNotNull(), "deleted").when(F.col("__found").isNull(), "missing").otherwise("live")
    out = joined.withColumn("status", status)
    shown = [F.when(F.col("status") == "live", F.col(f"__v{i}")).alias(c) for i, c in enumerate(columns)]
    return out.select("pos", F.col("want").alias("id"), "status", *shown).orderBy("pos")


def vector_at(live: DataFrame, row_id: str, vector: str, wanted: int) -> DataFrame:
    """The vector of one live row, or no row."""
    return live.where(F.col(row_id) == F.lit(int(wanted))).select(vector)


def high_water(rows: DataFrame, row_id: str) -> DataFrame:
    """One past the largest id ever written, deleted ones included; 0 if none."""
    return rows.agg(F.coalesce(F.max(row_id) + 1, F.lit(0).cast("bigint")).alias("high_water"))
