"""Several writers, readers beside a writer, lost state, cursors, and the kernels that must be exact to the bit."""

import json
import random
import threading
import time
from fractions import Fraction

import numpy as np
import pytest

from hexavane import Column, Database
from hexavane import errors as E
from hexavane.functions.scoring import fold_dot, lane_dot
from hexavane.language import parse
from hexavane.operators import batch_search

ABC = (Column("vector", "VECTOR", 2), Column("a", "INT"), Column("c", "TEXT"))


def item(i):
    return [i % 7 + 1, i % 3], {"a": i, "c": ["red", "green", "blue", "teal"][i % 4]}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_threads_share_a_handle(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as db:
        db.create_collection("t", ABC, 34)
        given, errors = [], []

        def work(n):
            for k in range(5):
                try:
                    given.append((db.insert("t", *item(100 * n + k)), 100 * n + k))
                except E.CapacityExceeded as e:
                    errors.append(e)

        threads = [threading.Thread(target=work, args=(n,)) for n in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(given) == 34 and len(errors) == 6 and sorted(i for i, _ in given) == list(range(34))
        assert {r["id"]: r["a"] for r in db.scan("t").collect()} == dict(given)
        assert db._stores[0].head.lsn < 34  # some were committed together


def test_readers_beside_a_writer(spark, tmp_path):
    root = str(tmp_path / "db")
    db = Database(spark, root)
    db.create_collection("t", ABC, 100)
    reader = Database(spark, root, read_only=True)
    assert reader.live_count("t") == 0
    for i in range(3):
        db.insert("t", *item(i))
        assert ids(reader.live_ids("t")) == list(range(i + 1)) and reader.high_water("t") == i + 1
    before = reader.scan("t")
    db.delete("t", 1)
    db.checkpoint()
    assert [r["id"] for r in before.collect()] == [0, 1, 2] and ids(reader.live_ids("t")) == [0, 2]
    db.create_collection("later", ABC, 5)
    db.insert("later", *item(4))
    assert reader.sql("SELECT a FROM later;").first()["a"] == 4 and [c.name for c in reader.collections()] == ["t", "later"]
    assert [r["status"] for r in reader.get("t", [0, 1, 9], ["a"]).collect()] == ["live", "deleted", "missing"]
    for change in (lambda: reader.insert("t", *item(1)), lambda: reader.delete("t", 0), lambda: reader.create_collection("x", ABC, 1), lambda: reader.sql("INSERT INTO t (vector, a, c) VALUES ([1, 2], 3, 'x');"), reader.checkpoint):
        with pytest.raises(E.ReadOnlyDatabase):
            change()
    reader.close()
    with pytest.raises(E.DatabaseLocked):
        Database(spark, root)
    db.close()


def test_a_writer_that_was_replaced_is_shut_out(spark, tmp_path):
    root = str(tmp_path / "db")
    a = Database(spark, root)
    a.create_collection("t", ABC, 100)
    a.insert("t", *item(1))
    b = Database(spark, root, break_lock=True)
    b.insert("t", *item(2))
    for change in (lambda: a.insert("t", *item(3)), lambda: a.delete("t", 0), a.checkpoint):
        with pytest.raises(E.WriterFenced):
            change()
    b.insert("t", *item(4))
    assert [r["a"] for r in b.scan("t").collect()] == [1, 2, 4]
    with pytest.raises(E.WriterFenced):
        a.close()
    b.close()
    with Database(spark, root) as again:
        assert [r["a"] for r in again.scan("t").collect()] == [1, 2, 4]


def test_lost_state_is_told(spark, tmp_path):
    root = tmp_path / "db"
    with Database(spark, str(root)) as db:
        db.create_collection("t", ABC, 100)
        db.insert("t", *item(1))
    heads = root / "collection-0" / "heads"
    text = {p: p.read_text() for p in heads.glob("*.json")}
    newest = max(text)

    def put(found):
        newest.write_text(found)
        (heads / f".{newest.name}.crc").unlink(missing_ok=True)

    put(json.dumps(json.loads(text[newest]) | {"format": 99}))
    with pytest.raises(E.UnsupportedVersion):
        Database(spark, str(root))
    put("{")
    with pytest.raises(E.CorruptSnapshot):
        Database(spark, str(root))
    put(json.dumps(json.loads(text[newest]) | {"rows": ["c-9-gone"]}))
    with pytest.raises(E.CorruptSnapshot):
        Database(spark, str(root))
    for p in heads.glob("*.json"):
        p.unlink()
    with pytest.raises(E.CorruptSnapshot):
        Database(spark, str(root))
    (root / ".catalog.json.crc").unlink(missing_ok=True)
    (root / "catalog.json").write_text(json.dumps({"collections": []}))
    with pytest.raises(E.UnsupportedVersion):
        Database(spark, str(root))
    with Database(spark, str(tmp_path / "other")) as db, pytest.raises(E.CapacityOverflow):
        db.create_collection("t", ABC, 2**63)


def test_checkpoints_in_the_background(spark, tmp_path):
    with Database(spark, str(tmp_path / "db"), checkpoint_seconds=0.2) as db:
        db.create_collection("t", ABC, 100)
        for i in range(4):
            db.insert("t", *item(i))
            db.delete("t", i - 1)
        until = time.time() + 30
        while db._stores[0].head.commits and time.time() < until:
            time.sleep(0.1)
        assert db._stores[0].head.commits == 0 and db.checkpoint_error is None and ids(db.live_ids("t")) == [3]


def test_cursor(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as db:
        db.create_collection("t", ABC, 100)
        db.insert_many("t", [item(i) for i in range(8)])
        db.delete_many("t", [0, 1, 4, 6])
        c = db.cursor("t", ["c", "a"], page=2)
        assert c.row is None and c.ordinal is None and c.column(0) is None
        assert c.seek_first() and (c.ordinal, c.row, c.column(1)) == (2, ("blue", 2), 2) and (c.fetched, c.skipped) == (1, 2)
        assert [i for i, _ in c] == [3, 5, 7] and (c.fetched, c.skipped) == (4, 4) and c.row is None and not c.next()
        assert c.seek(4) and c.ordinal == 5
        over = db.cursor("t", ids=[7, 4, 2, 99, 7])
        assert over.columns == ["a", "c"] and [i for i, _ in over] == [7, 2, 7] and (over.fetched, over.skipped) == (3, 2)
        assert not db.cursor("t", ids=[]).seek_first()


def test_positions_are_bytes():
    text = "SELECT a\nFROM 'é' nope"
    with pytest.raises(E.ParseError) as e:
        parse(text)
    at = text.index("'")
    assert (e.value.line, e.value.column) == (2, 6) and e.value.span[0] == at
    with pytest.raises(E.ParseError) as e:
        parse("INSERT INTO t (v) VALUES ('é日' nope);")
    assert e.value.column == len("INSERT INTO t (v) VALUES ('é日' ".encode()) + 1


def single(x: Fraction) -> np.float32:
    """The single-precision value nearest to ``x``, ties to even."""
    near = np.float32(float(x))
    some = [np.nextafter(near, np.float32(-np.inf)), near, np.nextafter(near, np.float32(np.inf))]
    return min(some, key=lambda c: (abs(Fraction(float(c)) - x), int(np.float32(c).view(np.int32)) & 1))


@pytest.mark.parametrize("dim", [1, 7, 8, 9, 15, 16, 31, 32, 127, 128, 768])
def test_lanes_to_the_bit(dim):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = (rng.normal(size=(3, dim)) * 10.0 ** rng.integers(-3, 4, (3, dim))).astype(np.float32)
        q = rng.normal(size=dim).astype(np.float32)
        got = lane_dot(x, q)
        for row, value in zip(x, got, strict=True):
            lanes = [np.float32(0)] * 8
            for i in range(dim - dim % 8):
                lanes[i % 8] = single(Fraction(float(row[i])) * Fraction(float(q[i])) + Fraction(float(lanes[i % 8])))
            total = np.float32(0)
            for lane in lanes:
                total = np.float32(total + lane)
            for i in range(dim - dim % 8, dim):
                total = single(Fraction(float(row[i])) * Fraction(float(q[i])) + Fraction(float(total)))
            assert total.view(np.int32) == value.view(np.int32)


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_batch_search(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0]), (302, [float("nan")] * 5), (303, [None] * 5), (304, [])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(3)
    queries = [(i, x[i].tolist()) for i in range(0, 100, 9)] + [(900, [2.0]), (901, None), (902, [1.0, 2.0])]
    q = spark.createDataFrame(queries, "q bigint, w array<float>")
    got = {}
    for r in batch_search(df, "id", "v", q, "q", "w", 10, block_bytes=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    wide = x.astype(float)
    for i, _ in queries[:-3]:
        score = fold_dot(wide, wide[i])
        assert got.pop(i) == [(int(k), score[k]) for k in np.lexsort((np.arange(300), -score))[:10]]
    assert got == {900: [(301, 2.0)]}
    assert batch_search(df, "id", "v", q.limit(0), "q", "w", 3).count() == 0


def test_random_threads_against_a_dictionary(spark, tmp_path):
    """Three threads insert and delete what they inserted; a reader never sees a row that cannot be there."""
    root, model, lock, wrong = str(tmp_path / "db"), {}, threading.Lock(), []
    db = Database(spark, root, compact_every=5)
    db.create_collection("t", ABC, 10_000)
    reader = Database(spark, root, read_only=True)

    def write(n):
        rng, own = random.Random(n), []
        for k in range(6):
            i = db.insert("t", *item(1000 * n + k))
            own.append(i)
            with lock:
                model[i] = 1000 * n + k
            if rng.random() < 0.4:
                gone = own.pop(rng.randrange(len(own)))
                with lock:
                    model.pop(gone)
                db.delete("t", gone)

    def read():
        for _ in range(4):
            for r in reader.scan("t").collect():
                if r["c"] != item(r["a"])[1]["c"]:
                    wrong.append(r)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and {r["id"]: r["a"] for r in db.scan("t").collect()} == model
    db.close()
    with Database(spark, root) as again:
        assert {r["id"]: r["a"] for r in again.scan("t").collect()} == model
