"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary folder, but only if the master is local: no
    other machine would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="hexavane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/hexavane-{uuid.uuid4().hex}/{name}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends here, and a lost executor costs no recomputation upstream."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave, once nothing reads them any more."""
    for t in tables:
        written = _WRITTEN.get(t.sparkSession.sparkContext.applicationId, [])
        if t._scratch in written:
            written.remove(t._scratch)
            _remove(t.sparkSession, t._scratch)


def written(spark: SparkSession) -> frozenset[str]:
    """Paths of the intermediate tables there are."""
    return frozenset(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, *, keep: list[DataFrame] | None = None, since: frozenset[str] = frozenset()) -> None:
    """Delete the intermediate tables made after ``since`` was taken, but ``keep``; call once results are written."""
    kept = {t._scratch for t in keep or ()} | since
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in [p for p in paths if p not in kept]:
        paths.remove(path)
        _remove(spark, path)
