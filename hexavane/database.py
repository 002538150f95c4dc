"""A database: a folder of collections, with the SQL dialect and the programmatic interface over them."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E
from .cursor import Cursor
from .language import parse
from .operators import batch_search, lookup, rows
from .operators import search as nearest
from .operators.search import check_k
from .plans.binder import BoundCreate, BoundInsert, BoundSearch, bind
from .plans.planner import plan_search, plan_select
from .schema import ROW_ID, VECTOR, Collection, Column, check_definition, check_row, check_vector
from .sources.external import external_rows
from .sources.files import Files
from .sources.store import FORMAT, Store

_LOCK = "writer.lock"
#: Rows of waiting inserts that one commit takes.
GROUP_ROWS = 1024


@dataclass(eq=False)
class Ticket:
    """Rows that wait for a commit, and what became of them."""

    values: list[tuple]
    ids: list[int] | None = None
    error: Exception | None = None

    def done(self) -> bool:
        return self.ids is not None or self.error is not None


class Database:
    """One writer, any number of readers. Mutations are durable when the call returns; reads are lazy DataFrames on a snapshot.

    ``configs`` are collections to register at open: an unknown id is added, a known one must match exactly.
    ``break_lock`` takes over from a writer that died; should it live still, its next change raises WriterFenced and does not
    count. ``read_only`` opens beside a writer, without the lock: each read is of the newest commit when it is asked for.
    ``checkpoint_seconds`` compacts in the background, at most so often.

    A handle may be used by several threads. Inserts that wait for each other are committed together.
    """

    def __init__(
        self, spark: SparkSession, path: str, configs: Iterable[Collection] = (), *, compact_every: int = 64, break_lock: bool = False, read_only: bool = False, checkpoint_seconds: float | None = None, score_mode: str = "f64"
    ):
        self.spark, self.files = spark, Files(spark, path)
        self.compact_every, self.score_mode, self.read_only = compact_every, score_mode, read_only
        self._token = uuid.uuid4().hex
        self._writing, self._waiting = threading.RLock(), threading.Lock()
        self._queue: dict[int, list[Ticket]] = {}
        self._external: dict[int, DataFrame] = {}
        self._stop = threading.Event()
        self.checkpoint_error: Exception | None = None
        if not read_only:
            if break_lock:
                self.files.remove(_LOCK)
            if not self.files.claim(_LOCK, self._token):
                raise E.DatabaseLocked(f"{self.files.root} has a writer; break_lock=True takes over from a dead one, read_only=True reads beside it")
        self._open = True
        try:
            self._by_id = self._load_catalog()
            self._stores = {i: Store(spark, self.files, c) for i, c in self._by_id.items()}
            if read_only:
                if list(configs):
                    raise E.ReadOnlyDatabase("collections cannot be registered")
            else:
                for store in self._stores.values():
                    store.seal()
                self._register(configs)
        except Exception:
            self._release()
            raise
        if checkpoint_seconds and not read_only:
            threading.Thread(target=self._checkpoints, args=(checkpoint_seconds,), daemon=True).start()

    def _checkpoints(self, seconds: float) -> None:
        while not self._stop.wait(seconds):
            try:
                self.checkpoint()
            except Exception as e:  # kept for the owner; the log alone is whole, too
                self.checkpoint_error = e
                return

    def _change(self) -> threading.RLock:
        """To be held while something is changed."""
        if self.read_only:
            raise E.ReadOnlyDatabase(f"{self.files.root} was opened for reading")
        return self._writing

    open = classmethod(lambda cls, *a, **b: cls(*a, **b))

    # -- catalog
    def _load_catalog(self) -> dict[int, Collection]:
        text = self.files.read("catalog.json")
        if text is None:
            return {}
        try:
            stored = json.loads(text)
            if stored.get("format") != FORMAT:
                raise E.UnsupportedVersion(f"catalog.json has format {stored.get('format')}, this is {FORMAT}")
            found = [Collection.from_json(d) for d in stored["collections"]]
        except (ValueError, KeyError, TypeError) as e:
            raise E.CorruptCatalog(f"catalog.json cannot be read: {e}") from e
        return {c.id: c for c in found}

    def _save_catalog(self) -> None:
        stored = [c.to_json() for i, c in sorted(self._by_id.items()) if i not in self._external]
        self.files.replace("catalog.json", json.dumps({"format": FORMAT, "collections": stored}))

    def _register(self, configs: Iterable[Collection]) -> None:
        added = []
        for c in configs:
            check_definition(c)
            if c.id in self._by_id:
                if self._by_id[c.id] != c:
                    raise E.CollectionConfigMismatch(f"collection {c.id} is stored with another definition")
                continue
            if c.name in self._names():
                raise E.CollectionExists(f"collection {c.name!r} exists")
            self._by_id[c.id] = c
            added.append(c)
        for c in added:  # heads first: a collection in the catalog has one
            self._stores[c.id] = Store(self.spark, self.files, c, create=True)
        if added:
            self._save_catalog()

    def _refresh(self) -> None:
        """A reader looks for collections that have come since."""
        if self.read_only:
            for i, c in self._load_catalog().items():
                if i not in self._by_id:
                    self._stores[i] = Store(self.spark, self.files, c)
                    self._by_id[i] = c

    def _names(self) -> dict[str, Collection]:
        self._refresh()
        return {c.name: c for c in list(self._by_id.values())}

    def collections(self) -> list[Collection]:
        """All collections by ascending id."""
        self._refresh()
        return [c for _, c in sorted(self._by_id.items())]

    def collection_id(self, name: str) -> int | None:
        found = self._names().get(name)
        return None if found is None else found.id

    def collection(self, which: int | str) -> Collection:
        found = self._names().get(which) if isinstance(which, str) else self._by_id.get(which)
        if found is None:
            raise E.UnknownCollection(f"no collection {which!r}")
        return found

    def _store(self, which: int | str) -> Store:
        c = self.collection(which)
        if c.id in self._external:
            raise E.ReadOnlyCollection(f"{c.name!r} is an external table")
        store = self._stores[c.id]
        if self.read_only:
            store.refresh()
        return store

    def _next_collection(self) -> int:
        return max(self._by_id, default=-1) + 1

    def create_collection(self, name: str, columns: Iterable[Column], capacity: int) -> int:
        with self._change():
            if not name:
                raise E.InvalidCollectionName("the name is empty")
            if name in self._names():
                raise E.CollectionExists(f"collection {name!r} exists")
            c = check_definition(Collection(self._next_collection(), name, capacity, tuple(columns)))
            self._stores[c.id] = Store(self.spark, self.files, c, create=True)
            self._by_id[c.id] = c
            self._save_catalog()
            return c.id

    def attach(self, name: str, df: DataFrame, row_id: str, columns: Iterable[Column]) -> int:
        """Extension: serve an external table, read-only, for the life of this handle."""
        if name in self._names():
            raise E.CollectionExists(f"collection {name!r} exists")
        c = check_definition(Collection(self._next_collection(), name, 2**63 - 1, tuple(columns)))
        self._by_id[c.id] = c
        self._external[c.id] = external_rows(df, row_id, c)
        return c.id

    # -- frames
    def live(self, which: int | str) -> DataFrame:
        """Live rows in the stored layout: the id and physical columns."""
        c = self.collection(which)
        if c.id in self._external:
            return self._external[c.id]
        store = self._store(c.id)
        return rows.live_rows(store.rows(), store.deleted(), ROW_ID)

    def _named(self, c: Collection, names: Iterable[str]) -> list[SparkColumn]:
        return [F.col(c.physical(n)).alias(n) for n in names]

    # -- writing
    def insert(self, which: int | str, vector, row=()) -> int:
        """Validate, allocate an id, commit. Returns the id."""
        return self.insert_many(which, [(vector, row)])[0]

    def insert_many(self, which: int | str, items: Iterable[tuple]) -> list[int]:
        """Extension: several rows in one commit."""
        self._change()  # not held here: who waits for a commit must be able to queue
        store = self._store(which)
        c = store.collection
        values = [check_row(c, v, r) for v, r in items]
        if not values:
            return []
        ticket = Ticket(values)
        with self._waiting:
            self._queue.setdefault(c.id, []).append(ticket)
        while not ticket.done():
            with self._change():  # who holds it commits for those who wait
                if not ticket.done():
                    self._commit_waiting(store)
        if ticket.error is not None:
            raise ticket.error
        return ticket.ids

    def _commit_waiting(self, store: Store) -> None:
        """One commit of the inserts that came first, ``GROUP_ROWS`` rows unless a single one has more."""
        taken: list[Ticket] = []
        with self._waiting:
            queue = self._queue[store.collection.id]
            while queue and (not taken or sum(len(t.values) for t in taken) + len(queue[0].values) <= GROUP_ROWS):
                taken.append(queue.pop(0))
        rows_, given = [], []
        at = store.head.next_id
        for t in taken:
            if at + len(t.values) > store.collection.capacity:
                t.error = self._full(store, at)
                continue
            given.append((t, list(range(at, at + len(t.values)))))
            rows_ += [(i, *v) for i, v in zip(given[-1][1], t.values, strict=True)]
            at += len(t.values)
        if not given:
            return
        try:
            frame = store.frame(rows_)
            store.commit(frame if len(rows_) > 10_000 else frame.coalesce(1), at)
        except Exception as e:
            for t, _ in given:
                t.error = e
            return
        for t, ids in given:
            t.ids = ids
        self._maybe_compact(store)

    def insert_frame(self, which: int | str, df: DataFrame, *, order_by: Iterable[str], stream: tuple[str, int] | None = None) -> int:
        """Extension: bulk insert of a DataFrame with the collection's columns. Returns the number of rows.

        Ids follow ``order_by``, which should be a total order. They are dense: rows are range-partitioned by it, counted
        by partition, and numbered from each partition's offset; no row meets another in a global window. Bad rows
        (null, NaN, wrong dimension, non-finite) fail the whole insert before anything counts.
        """
        with self._change():
            store = self._store(which)
        c = store.collection
        picked = df.select(*[F.col(x.name).cast("array<float>").alias(f"c{i}") if x.kind == VECTOR else _strict(df, x).alias(f"c{i}") for i, x in enumerate(c.columns)], *[F.col(k).alias(f"__k{j}") for j, k in enumerate(order_by)])
        keys = [k for k in picked.columns if k.startswith("__k")]
        checked = picked.withColumn(f"c{c.index[c.vector.name]}", F.when(_valid(c), F.col(f"c{c.index[c.vector.name]}")).otherwise(F.raise_error(F.lit("a row breaks the collection's rules"))))
        folder = f"{store.folder}/stage-{uuid.uuid4().hex}"
        try:
            checked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)).write.parquet(self.files.at(folder))
            staged = self.spark.read.parquet(self.files.at(folder))
            counts = sorted((r["__part"], r["n"]) for r in staged.groupBy("__part").agg(F.count("*").alias("n")).collect())
            total = sum(n for _, n in counts)
            if not total:
                return 0
            with self._change():
                if stream and store.head.streams.get(stream[0], -1) >= stream[1]:
                    return 0
                first = at = self._allocate(store, total)
                offsets = []
                for part, n in counts:
                    offsets.append((part, at))
                    at += n
                start = self.spark.createDataFrame(offsets, "__part int, __first bigint")
                numbered = staged.join(F.broadcast(start), "__part").withColumn(ROW_ID, F.col("__first") + F.col("__at"))
                store.commit(numbered, first + total, stream)
                self._maybe_compact(store)
        finally:
            self.files.remove(folder)
        return total

    def _allocate(self, store: Store, n: int) -> int:
        if store.head.next_id + n > store.collection.capacity:
            raise self._full(store, store.head.next_id)
        return store.head.next_id

    def _full(self, store: Store, used: int) -> E.CapacityExceeded:
        return E.CapacityExceeded(f"{store.collection.name!r} holds {store.collection.capacity} ids, {used} are used")

    def delete(self, which: int | str, row_id: int) -> None:
        """Tombstone a row. Idempotent; an id never handed out is left alone."""
        self.delete_many(which, [row_id])

    def delete_many(self, which: int | str, ids: Iterable[int]) -> None:
        with self._change():
            store = self._store(which)
            known = sorted({i for i in ids if 0 <= i < store.head.next_id})
            if known:
                store.bury(store.tombstones(known))
                self._maybe_compact(store)

    def delete_where(self, which: int | str, predicate: SparkColumn) -> None:
        """Extension: tombstone the live rows a predicate selects; the ids stay on the executors."""
        with self._change():
            store = self._store(which)
            store.bury(self.live(which).where(predicate))
            self._maybe_compact(store)

    def _maybe_compact(self, store: Store) -> None:
        if store.head.commits >= self.compact_every:
            store.compact()

    # -- reading
    def search(self, which: int | str, query, k: int, *, where: SparkColumn | None = None, score_mode: str | None = None) -> DataFrame:
        """id and score of the k nearest live rows by dot product, best first."""
        c = self.collection(which)
        check_k(k)
        best = nearest(self.live(which), ROW_ID, c.physical(c.vector.name), check_vector(c, query), k, where=where, score_mode=score_mode or self.score_mode)
        return best.select(F.col(ROW_ID).alias("id"), "score")

    def batch_search(self, which: int | str, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
        """Extension: top k for each row of ``queries``."""
        c = self.collection(which)
        return batch_search(self.live(which), ROW_ID, c.physical(c.vector.name), queries, query_id, query_vector, k)

    def scan(self, which: int | str) -> DataFrame:
        """id and all scalars of the live rows, by ascending id."""
        c = self.collection(which)
        return self.live(which).orderBy(ROW_ID).select(F.col(ROW_ID).alias("id"), *self._named(c, [x.name for x in c.scalars]))

    def scan_over(self, which: int | str, ids: Iterable[int]) -> DataFrame:
        """Like scan, over an id list in its order, with its position; absent ids are skipped."""
        c = self.collection(which)
        return rows.scan_over(self.live(which), ROW_ID, ids).select("pos", F.col(ROW_ID).alias("id"), *self._named(c, [x.name for x in c.scalars]))

    def cursor(self, which: int | str, columns: Iterable[str] | None = None, ids: Iterable[int] | None = None, *, page: int = 1024) -> Cursor:
        """Rows one by one, with the scalars ``columns`` (all by default), in id order or over ``ids``."""
        return Cursor(self, which, columns, ids, page)

    def get(self, which: int | str, ids: Iterable[int], columns: Iterable[str]) -> DataFrame:
        """pos, id, status and the asked-for scalars, for each id."""
        c = self.collection(which)
        names = [c.scalar(n).name for n in columns]
        store = self._store(which)
        found = rows.fetch_rows(store.rows(), store.deleted(), ROW_ID, ids, [c.physical(n) for n in names])
        return found.select("pos", "id", "status", *self._named(c, names))

    def vector_at(self, which: int | str, row_id: int) -> DataFrame:
        c = self.collection(which)
        return rows.vector_at(self.live(which), ROW_ID, c.physical(c.vector.name), row_id).toDF(c.vector.name)

    def eq(self, which: int | str, column: str, value) -> SparkColumn:
        """Predicate for ``search(where=...)`` and lookups; compose with & | ~."""
        c = self.collection(which)
        return lookup.lookup_eq(c.scalar(column), value, c.physical(column))

    def range(self, which: int | str, column: str, op: str, value) -> SparkColumn:
        c = self.collection(which)
        return lookup.lookup_range(c.scalar(column), op, value, c.physical(column))

    def lookup(self, which: int | str, predicate: SparkColumn) -> DataFrame:
        """Ids of the live rows a predicate selects."""
        return self.live(which).where(predicate).select(F.col(ROW_ID).alias("id"))

    def lookup_eq(self, which: int | str, column: str, value) -> DataFrame:
        return self.lookup(which, self.eq(which, column, value))

    def lookup_range(self, which: int | str, column: str, op: str, value) -> DataFrame:
        return self.lookup(which, self.range(which, column, op, value))

    def live_ids(self, which: int | str) -> DataFrame:
        return self.live(which).select(F.col(ROW_ID).alias("id"))

    def live_count(self, which: int | str) -> int:
        return self.live(which).count()

    def high_water(self, which: int | str) -> int:
        return self._store(which).head.next_id

    # -- SQL
    def sql(self, text: str, *, allow_vector: bool = False) -> DataFrame:
        """Run one statement. Mutations happen now and give an empty DataFrame; reads are lazy."""
        bound = bind(parse(text), self._names())
        if isinstance(bound, BoundCreate):
            if len({x.name for x in bound.columns}) < len(bound.columns):
                raise E.CompileDuplicateColumn("a column name occurs twice")
            self.create_collection(bound.name, bound.columns, bound.capacity)
        elif isinstance(bound, BoundInsert):
            self.insert(bound.collection.id, bound.vector, bound.row)
        elif isinstance(bound, BoundSearch):
            return plan_search(bound, self.live(bound.collection.id), score_mode=self.score_mode)
        else:
            return plan_select(bound, self.live(bound.collection.id), allow_vector=allow_vector)
        return self.spark.createDataFrame([], T.StructType([]))

    # -- life cycle
    def checkpoint(self) -> None:
        """Compact every collection that has new commits."""
        with self._change():
            for store in list(self._stores.values()):
                store.compact()

    def _release(self) -> None:
        self._stop.set()
        if not self.read_only and self.files.read(_LOCK) == self._token:
            self.files.remove(_LOCK)
        self._open = False

    def close(self) -> None:
        """Compact and give the lock back. A writer that was shut out only closes."""
        if not self._open:
            return
        self._stop.set()
        try:
            if not self.read_only:
                self.checkpoint()
        finally:
            self._release()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _strict(df: DataFrame, x: Column) -> SparkColumn:
    """A scalar of a compatible Spark type; anything else is refused before Spark would coerce it."""
    kind = df.schema[x.name].dataType
    allowed = {"INT": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "FLOAT": (T.FloatType, T.DoubleType), "TEXT": (T.StringType,)}[x.kind]
    if not isinstance(kind, allowed):
        raise E.TypeMismatch(f"column {x.name!r} is {x.kind}, the table has {kind.simpleString()}")
    return F.col(x.name).cast({"INT": "bigint", "FLOAT": "double", "TEXT": "string"}[x.kind])


def _valid(c: Collection) -> SparkColumn:
    ok = F.lit(True)
    for i, x in enumerate(c.columns):
        v = F.col(f"c{i}")
        ok &= v.isNotNull()
        if x.kind == "FLOAT":
            ok &= ~F.isnan(v)
        elif x.kind == VECTOR:
            ok &= (F.size(v) == x.dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.coalesce(ok, F.lit(False))
