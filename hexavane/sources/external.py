"""Extension: any table Spark can read, served as a read-only collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_ID, VECTOR, Collection

_CAST = {"INT": "bigint", "FLOAT": "double", "TEXT": "string"}


def external_rows(df: DataFrame, row_id: str, c: Collection) -> DataFrame:
    """``df`` in the stored layout. Rows whose vector is null, of another length or not finite are not part of the collection."""
    columns = [F.col(row_id).cast("bigint").alias(ROW_ID)]
    for i, x in enumerate(c.columns):
        columns.append(F.col(x.name).cast("array<float>" if x.kind == VECTOR else _CAST[x.kind]).alias(f"c{i}"))
    v = F.col(f"c{c.index[c.vector.name]}")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(*columns).where((F.size(v) == c.vector.dim) & finite)
