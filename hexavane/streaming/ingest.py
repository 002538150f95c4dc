"""Extension: a stream of rows into a collection, each micro-batch one commit, applied exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..database import Database


def ingest(db: Database, which: int | str, stream: DataFrame, checkpoint: str, *, name: str, order_by: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Start the query. The commit stores the batch number under ``name`` in the same atomic step as the rows, so a batch
    that Spark replays after a crash is recognised and skipped."""

    def apply(batch: DataFrame, number: int) -> None:
        store = db._store(which)
        if store.head.streams.get(name, -1) >= number:
            return
        db.insert_frame(which, batch, order_by=order_by, stream=(name, number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
