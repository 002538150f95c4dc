"""Versioned Parquet store of one collection.

collection-<id>/c-<lsn>-<mark>/   inserted rows of one commit
collection-<id>/d-<lsn>-<mark>/   tombstones of one commit
collection-<id>/b-..., e-...      all live rows, and all tombstones, up to a commit, compacted
collection-<id>/heads/<n>.json    the folders that count, next row id, stream positions; the largest n holds

Creating the next head is the commit point. A head is never replaced and its name can be taken once only, so of two writers
that go on from the same head one fails. A writer takes the next name as soon as it opens, which shuts out any before it,
and folder names are never used twice. A reader opens only the folders that a head names, so a half-written commit is never
seen and a DataFrame keeps the snapshot it was built on.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import CorruptSnapshot, UnsupportedVersion, WriterFenced
from ..schema import ROW_ID, Collection
from .files import Files

FORMAT = 2
#: Older heads that stay for readers which have just listed them.
SPARE_HEADS = 4


@dataclass(frozen=True)
class Head:
    version: int = 0
    rows: list[str] = field(default_factory=list)
    stones: list[str] = field(default_factory=list)
    next_id: int = 0
    lsn: int = 0
    commits: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    format: int = FORMAT


class Store:
    """``create`` makes the first head; without it a missing head is an error, as the catalog says there is a collection."""

    def __init__(self, spark: SparkSession, files: Files, collection: Collection, *, create: bool = False):
        self.spark, self.files, self.collection = spark, files, collection
        self.folder = f"collection-{collection.id}"
        self.schema = T.StructType([T.StructField(f.name, f.dataType, f.name != ROW_ID, f.metadata) for f in collection.struct()])
        self.stone_schema = T.StructType([T.StructField(ROW_ID, T.LongType(), False)])
        found = self._latest()
        if found is None:
            if not create:
                raise CorruptSnapshot(f"{self.folder} has no head, though the catalog lists it")
            self.head = Head()
            self._publish(Head(version=1))
        else:
            self.head = found
            lost = [f for f in [*found.rows, *found.stones] if not files.exists(f"{self.folder}/{f}")]
            if lost:
                raise CorruptSnapshot(f"{self.folder} lacks {', '.join(lost)}")

    # -- heads
    def _latest(self) -> Head | None:
        for _ in range(5):  # a head may go between listing and reading, if newer ones come
            names = [n for n in self.files.names(f"{self.folder}/heads") if n.endswith(".json")]
            if not names:
                return None
            text = self.files.read(f"{self.folder}/heads/{max(names)}")
            if text is not None:
                return self._parse(max(names), text)
        raise CorruptSnapshot(f"{self.folder}: heads go faster than they can be read")

    def _parse(self, name: str, text: str) -> Head:
        try:
            found = json.loads(text)
            if found["format"] != FORMAT:
                raise UnsupportedVersion(f"{self.folder}/heads/{name} has format {found['format']}, this is {FORMAT}")
            return Head(**found)
        except (ValueError, TypeError, KeyError) as e:
            raise CorruptSnapshot(f"{self.folder}/heads/{name} cannot be read: {e}") from e

    def _publish(self, head: Head) -> None:
        if not self.files.create(f"{self.folder}/heads/{head.version:012d}.json", json.dumps(asdict(head))):
            raise WriterFenced(f"{self.folder}: another writer went on from version {self.head.version}")
        self.head = head
        old = head.version - SPARE_HEADS
        if old > 0:
            self.files.remove(f"{self.folder}/heads/{old:012d}.json")

    def seal(self) -> None:
        """Take the next head without a change: what an earlier writer still has under way cannot be published any more."""
        while True:
            try:
                return self._publish(replace(self.head, version=self.head.version + 1))
            except WriterFenced:  # it was quicker; that commit counts
                self.refresh()

    def refresh(self) -> None:
        """Go on to the newest head."""
        found = self._latest()
        if found is None:
            raise CorruptSnapshot(f"{self.folder} has lost its heads")
        self.head = found

    # -- reading
    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        paths = [self.files.at(f"{self.folder}/{n}") for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read(self.head.rows, self.schema)

    def deleted(self) -> DataFrame:
        return self._read(self.head.stones, self.stone_schema)

    # -- writing
    def frame(self, rows: list[tuple]) -> DataFrame:
        """``rows``: (id, columns ...)."""
        return self.spark.createDataFrame(rows, self.schema)

    def tombstones(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], self.stone_schema).coalesce(1)

    def _write(self, df: DataFrame, kind: str, lsn: int) -> str:
        name = f"{kind}-{lsn}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.files.at(f"{self.folder}/{name}"))
        return name

    def commit(self, rows: DataFrame, next_id: int, stream: tuple[str, int] | None = None) -> int:
        """Write rows and make them count. Returns the commit's sequence number."""
        name = self._write(rows.select(*self.schema.names), "c", self.head.lsn + 1)
        streams = self.head.streams | ({stream[0]: stream[1]} if stream else {})
        return self._next(name, rows=[*self.head.rows, name], next_id=next_id, streams=streams)

    def bury(self, stones: DataFrame) -> int:
        """The same for tombstones."""
        name = self._write(stones.select(ROW_ID), "d", self.head.lsn + 1)
        return self._next(name, stones=[*self.head.stones, name])

    def _next(self, name: str, **changed) -> int:
        now = self.head
        try:
            self._publish(replace(now, version=now.version + 1, lsn=now.lsn + 1, commits=now.commits + 1, **changed))
        except WriterFenced:
            self.files.remove(f"{self.folder}/{name}")
            raise
        return self.head.lsn

    def compact(self) -> None:
        """Rewrite live rows and tombstones as one folder each. Old folders go at the next compaction, so open readers keep
        theirs until then."""
        now = self.head
        if not now.commits:
            return
        dead = self.deleted().distinct()
        live = self.rows().join(dead, ROW_ID, "left_anti").select(*self.schema.names) if now.stones else self.rows()
        rows = self._write(live, "b", now.lsn)
        stones = [self._write(dead, "e", now.lsn)] if now.stones else []
        self._publish(replace(now, version=now.version + 1, rows=[rows], stones=stones, commits=0))
        kept = {*now.rows, *now.stones, rows, *stones}
        for name in self.files.names(self.folder):
            if name[:2] in ("b-", "c-", "d-", "e-") and name not in kept:
                self.files.remove(f"{self.folder}/{name}")
