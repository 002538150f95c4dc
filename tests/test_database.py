import math
import random

import pytest

from hexavane import Collection, Column, Database
from hexavane import errors as E

DOCS = "CREATE COLLECTION docs (author TEXT, vector VECTOR(4), title TEXT, published_at INT) WITH (capacity = 1024);"
ABC = (Column("vector", "VECTOR", 2), Column("a", "INT"), Column("b", "FLOAT"), Column("c", "TEXT"))


@pytest.fixture()
def db(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as d:
        yield d


def ids(df):
    return [r["id"] for r in df.orderBy("id").collect()]


def seed(db, n=3):
    db.sql(DOCS)
    db.insert_many("docs", [([i + 1, 0, 0, 0], {"author": "alice", "title": f"doc {i}", "published_at": 2000 + i}) for i in range(n)])


def test_ranked_search(db):
    db.sql(DOCS)
    for title, x in (("far", 1), ("near", 3), ("mid", 2)):
        db.sql(f"INSERT INTO docs (title, vector, published_at, author) VALUES ('{title}', [{x}, 0, 0, 0], 1, 'a');")
    out = db.sql("SEARCH TOP 5 NEAREST TO [1,0,0,0] FROM docs RETURNING title, ID, Score, title;")
    assert out.columns == ["title", "id", "score", "title"]
    assert [tuple(r)[:3] for r in out.collect()] == [("near", 1, 3.0), ("mid", 2, 2.0), ("far", 0, 1.0)]
    assert db.sql("SEARCH TOP 1 NEAREST TO [1,0,0,0] FROM docs;").columns == ["author", "title", "published_at"]


@pytest.mark.parametrize("k", [1, 3, 6, 50])
def test_score_follows_id(db, k):
    seed(db, 6)
    got = [tuple(r) for r in db.search("docs", [1, 0, 0, 0], k).collect()]
    assert got == [(i, i + 1.0) for i in range(5, -1, -1)][:k]
    assert got == [tuple(r) for r in db.search("docs", [1, 0, 0, 0], k, score_mode="f32_lane").collect()]


def test_error_stages(db):
    db.sql(DOCS)
    cases = [
        ("SELECT", "parse"),
        ("SELECT a FROM none;", "bind"),
        ("SELECT id FROM docs;", "bind"),
        ("SELECT Title FROM docs;", "bind"),
        ("SEARCH TOP 0 NEAREST TO [1,0,0,0] FROM docs;", "bind"),
        ("SEARCH TOP 1 NEAREST TO [1] FROM docs RETURNING nope;", "bind"),
        ("SEARCH TOP 1 NEAREST TO [1,0,0,0] FROM docs RETURNING vector;", "bind"),
        (DOCS, "bind"),
        ("CREATE COLLECTION x (a INT) WITH (capacity = 1);", "bind"),
        ("INSERT INTO docs (author, author, vector, title) VALUES ('a', 'b', [1,2,3,4], 't');", "bind"),
        ("INSERT INTO docs (author) VALUES ('a');", "bind"),
        ("INSERT INTO docs (author, vector, title, published_at) VALUES ('a', [1], 't', 1);", "bind"),
        ("INSERT INTO docs (author, vector, title, published_at) VALUES ('a', [1,2,3,4], 't', 1.5);", "bind"),
        ("CREATE COLLECTION x (v VECTOR(0), a INT) WITH (capacity = 10);", "compile"),
        ("CREATE COLLECTION x (v VECTOR(2), a INT, a INT) WITH (capacity = 10);", "compile"),
        ("CREATE COLLECTION x (v VECTOR(2), ID INT) WITH (capacity = 4);", "engine"),
        ("CREATE COLLECTION x (v VECTOR(2)) WITH (size = 4);", "engine"),
        ("SELECT vector FROM docs;", "unsupported"),
    ]
    for text, stage in cases:
        with pytest.raises(E.QueryError) as e:
            db.sql(text)
        assert e.value.stage == stage, text
    assert db.live_count("docs") == 0


def test_names_differ_only_in_case_and_score_is_shadowed(db):
    db.create_collection("Odd", [Column("a", "INT"), Column("A", "TEXT"), Column("v", "VECTOR", 1), Column("score", "FLOAT")], 8)
    db.insert("Odd", [2], {"A": "x", "a": 1, "score": 9.0})
    assert tuple(db.sql("SELECT A, a, score FROM Odd;").first()) == ("x", 1, 9.0)
    assert tuple(db.sql("SEARCH TOP 1 NEAREST TO [3] FROM Odd RETURNING score, A;").first()) == (6.0, "x")


def test_predicates(db):
    db.create_collection("t", ABC, 100)
    rows = [(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, "x"), (4, -0.0, "z")]
    db.insert_many("t", [([a, 0], {"a": a, "b": b, "c": c}) for a, b, c in rows])
    rng = lambda col, op, v: ids(db.lookup_range("t", col, op, v))
    assert [rng("a", op, 2) for op in ("<", "<=", ">", ">=")] == [[0], [0, 1], [2, 3], [1, 2, 3]]
    assert rng("b", "<", 2.5) == [0, 1, 3] and rng("b", ">", 2.5) == [2]
    assert ids(db.lookup_eq("t", "b", 0.0)) == ids(db.lookup_eq("t", "b", -0.0)) == [3]
    assert rng("b", "<", -0.0) == [] and rng("b", "<=", -0.0) == [3]
    assert ids(db.lookup_eq("t", "c", "x")) == [0, 2] and ids(db.lookup_eq("t", "c", "q")) == []
    assert rng("c", ">=", "a") == [] and rng("c", "<", 5) == []
    for bad, kind in (((lambda: db.lookup_eq("t", "a", 1.0)), E.TypeMismatch), ((lambda: db.lookup_range("t", "b", "<", 1)), E.TypeMismatch), ((lambda: db.lookup_eq("t", "b", math.nan)), E.NaNRejected), ((lambda: db.lookup_eq("t", "q", 1)), E.UnknownColumn), ((lambda: db.insert("t", [1, math.inf], {"a": 1, "b": 1.0, "c": ""})), E.NonFiniteVector), ((lambda: db.insert("t", [1], {"a": 1, "b": 1.0, "c": ""})), E.DimensionMismatch), ((lambda: db.insert("t", [1, 1], {"a": 1})), E.IncompleteRow), ((lambda: db.search("t", [1, 1], 0)), E.InvalidTopK)):
        with pytest.raises(kind):
            bad()
    both = db.eq("t", "c", "x") & db.range("t", "a", ">", 1)
    assert ids(db.lookup("t", both)) == [2]
    assert [r["id"] for r in db.search("t", [1, 0], 9, where=db.range("t", "a", "<", 3)).collect()] == [1, 0]


def test_delete_get_scan(db):
    seed(db, 8)
    before = db.scan("docs")
    for i in (1, 4, 6, 4, 99):
        db.delete("docs", i)
    assert before.count() == 8
    assert [r["id"] for r in db.scan("docs").collect()] == [0, 2, 3, 5, 7]
    assert db.live_count("docs") == 5 and db.high_water("docs") == 8 and ids(db.live_ids("docs")) == [0, 2, 3, 5, 7]
    assert [(r["pos"], r["id"]) for r in db.scan_over("docs", [7, 1, 0, 7]).collect()] == [(0, 7), (2, 0), (3, 7)]
    got = db.get("docs", [4, 3, 50], ["title"]).collect()
    assert [(r["status"], r["title"]) for r in got] == [("deleted", None), ("live", "doc 3"), ("missing", None)]
    assert db.vector_at("docs", 3).first()["vector"] == [4, 0, 0, 0] and db.vector_at("docs", 4).first() is None
    db.checkpoint()
    assert [r["status"] for r in db.get("docs", [4, 3, 50], ["title"]).collect()] == ["deleted", "live", "missing"]
    db.delete_where("docs", db.range("docs", "published_at", ">=", 2005))
    assert ids(db.live_ids("docs")) == [0, 2, 3]


def test_reopen_capacity_and_lock(spark, tmp_path):
    root = str(tmp_path / "db")
    db = Database(spark, root)
    db.sql("CREATE COLLECTION tiny (v VECTOR(2), a INT) WITH (capacity = 1);")
    db.sql("INSERT INTO tiny (v, a) VALUES ([1, 2], 3);")
    db.delete("tiny", 0)
    with pytest.raises(E.CapacityExceeded):
        db.insert("tiny", [1, 1], {"a": 1})
    with pytest.raises(E.DatabaseLocked):
        Database(spark, root)
    again = Database(spark, root, break_lock=True)
    assert again.high_water("tiny") == 1 and again.live_count("tiny") == 0 and again.collection_id("tiny") == 0
    again.close()
    with pytest.raises(E.CollectionConfigMismatch):
        Database(spark, root, [Collection(0, "tiny", 2, (Column("v", "VECTOR", 2), Column("a", "INT")))])
    (tmp_path / "db" / "catalog.json").write_text("{")
    with pytest.raises(E.CorruptCatalog):
        Database(spark, root)


def test_bulk_and_stream(spark, tmp_path):
    from hexavane.streaming import ingest

    with Database(spark, str(tmp_path / "db")) as db:
        db.create_collection("t", [Column("v", "VECTOR", 2), Column("k", "INT")], 1000)
        rows = spark.createDataFrame([([float(i), 1.0], i) for i in range(100)], "v array<float>, k bigint")
        assert db.insert_frame("t", rows, order_by=["k"]) == 100
        assert [(r["id"], r["k"]) for r in db.scan("t").collect()] == [(i, i) for i in range(100)]
        bad = spark.createDataFrame([([1.0], 1)], "v array<float>, k bigint")
        with pytest.raises(Exception, match="rules"):
            db.insert_frame("t", bad, order_by=["k"])
        assert db.live_count("t") == 100
        rows.where("k < 10").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        for _ in range(2):
            ingest(db, "t", stream, str(tmp_path / "ck"), name="feed", order_by=["k"]).awaitTermination()
        assert db.live_count("t") == 110


def test_random_model(spark, tmp_path):
    """Random inserts, deletes, compactions and crashes against a dictionary."""
    rng, root, model, given = random.Random(7), str(tmp_path / "db"), {}, 0
    db = Database(spark, root, compact_every=6)
    db.create_collection("chaos", ABC, 4096)
    for _ in range(25):
        act = rng.random()
        if act < 0.5:
            items = [([rng.randint(-8, 7) / 4, rng.randint(-8, 7) / 4], {"a": rng.randint(0, 7), "b": rng.randint(-8, 7) / 4, "c": rng.choice("rgbt")}) for _ in range(rng.randint(1, 9))]
            for i, item in zip(db.insert_many("chaos", items), items, strict=True):
                assert i == given
                model[i], given = item, given + 1
        elif act < 0.75 and given:
            gone = [rng.randrange(given) for _ in range(3)]
            db.delete_many("chaos", gone)
            for g in gone:
                model.pop(g, None)
        elif act < 0.85:
            db.checkpoint()
        else:
            db = Database(spark, root, compact_every=6, break_lock=True)
    assert {r["id"]: (r["a"], r["b"], r["c"]) for r in db.scan("chaos").collect()} == {i: (x["a"], x["b"], x["c"]) for i, (_, x) in model.items()}
    q = [0.5, -0.25]
    want = sorted(((sum(x * y for x, y in zip(v, q, strict=True)), -i) for i, (v, _) in model.items()), reverse=True)[:10]
    assert [(r["score"], -r["id"]) for r in db.search("chaos", q, 10).collect()] == want
    assert ids(db.lookup_eq("chaos", "a", 3)) == sorted(i for i, (_, x) in model.items() if x["a"] == 3)
    db.close()
