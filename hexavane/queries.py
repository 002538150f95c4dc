"""The query catalogue: each operator on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .database import Database
from .functions.scoring import dot_f64
from .operators import batch_search, fetch_rows, high_water, live_rows, lookup_eq, lookup_range, scan_over, search, vector_at
from .plans.binder import bind
from .plans.planner import plan_search, plan_select
from .language import parse
from .schema import Collection, Column
from .sources.external import external_rows

#: The collection that the embeddings table is, with vec_id as the row id.
EMBEDDINGS = Collection(0, "embeddings", 2**62, (Column("embedding", "VECTOR", 64), Column("label", "INT")))
_S = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_FROM = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("label", F.col("label").cast("bigint"))


def _query(spark: SparkSession, d: str) -> list[float]:
    """The probe: the vector of row 7, a single row."""
    return list(table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0])


def _top(spark, d, k=10, where=None) -> DataFrame:
    return search(_embeddings(spark, d), "vec_id", "embedding", _query(spark, d), k, where=where)


def _sql_read(spark, d, text: str) -> DataFrame:
    """A statement of the dialect, over the embeddings table served as a collection."""
    live = external_rows(_embeddings(spark, d), "vec_id", EMBEDDINGS)
    bound = bind(parse(text), {"embeddings": EMBEDDINGS})
    return plan_search(bound, live) if hasattr(bound, "k") else plan_select(bound, live)


#: The orders table with a vector column, which a collection has: its total price.
ORDERS = Collection(1, "orders", 2**62, (Column("price", "VECTOR", 1), Column("o_custkey", "INT"), Column("o_orderkey", "INT"), Column("o_orderstatus", "TEXT")))


def _orders_reordered(spark, d) -> DataFrame:
    """SELECT of two columns in another order than they are declared in."""
    df = table(spark, d, "orders").withColumn("price", F.array(F.col("o_totalprice").cast("float")))
    bound = bind(parse("SELECT o_orderstatus, o_orderkey FROM orders;"), {"orders": ORDERS})
    return plan_select(bound, external_rows(df, "o_orderkey", ORDERS))


def _literal(spark, d) -> str:
    return "[" + ", ".join(f"{x:.60f}" for x in _query(spark, d)) + "]"


def _ranked(spark, d) -> DataFrame:
    best = _top(spark, d).select(F.col("vec_id").alias("id"), "score")
    return best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint").alias("rank"))


def _dead(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 7 = 0").select("vec_id")


def _alive(spark, d) -> DataFrame:
    return live_rows(_embeddings(spark, d), _dead(spark, d), "vec_id")


def _excludes_deleted(spark, d) -> DataFrame:
    return search(_alive(spark, d), "vec_id", "embedding", _query(spark, d), 10).select(F.col("vec_id").alias("id"), "score")


def _pick(name: str, kind: str, probe, *shown: str, op: str = "="):
    column = Column(name, kind)
    cast = {"INT": "bigint", "FLOAT": "double", "TEXT": "string"}[kind]

    def run(spark, d, where_from):
        df = table(spark, d, where_from)
        if cast != dict(df.dtypes)[name]:
            df = df.withColumn(name, F.col(name).cast(cast))
        return df.where(lookup_eq(column, probe) if op == "=" else lookup_range(column, op, probe)).select(*shown)

    return run


def _lookup(where_from: str, name: str, kind: str, probe, *shown: str, op: str = "="):
    run = _pick(name, kind, probe, *shown, op=op)
    return lambda spark, d: run(spark, d, where_from)


def _combined(both: bool):
    def run(spark, d):
        df = table(spark, d, "orders")
        a = lookup_range(Column("o_totalprice", "FLOAT"), ">=", 200000.0)
        b = lookup_eq(Column("o_orderstatus", "TEXT"), "F")
        return df.where(a & b if both else a | b).select("o_orderkey")

    return run


def _scan_over(spark, d) -> DataFrame:
    return scan_over(_embeddings(spark, d), "vec_id", [6, 1, 4, 1, 999999]).select("pos", "vec_id", "label")


def _get_rows(spark, d) -> DataFrame:
    return fetch_rows(_embeddings(spark, d), _dead(spark, d), "vec_id", [0, 3, 7, 12, 999999], ["label"])


def _vector_at(spark, d) -> DataFrame:
    one = vector_at(_embeddings(spark, d), "vec_id", "embedding", 7)
    return one.select(F.posexplode("embedding").alias("pos", "value")).select(F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def _sql_round_trip(spark, d) -> DataFrame:
    """CREATE, INSERT and SEARCH on a database of its own, in the folder the session shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{(shared or tempfile.gettempdir()).rstrip('/')}/hexavane-demo-{uuid.uuid4().hex}"
    db, name = Database(spark, root), "docs"
    db.sql(f"CREATE COLLECTION {name} (author TEXT, vector VECTOR(4), title TEXT, published_at INT) WITH (capacity = 1024);")
    for title, x, year in (("far", 1, 2001), ("near", 3, 2003), ("mid", 2, 2002)):
        db.sql(f"INSERT INTO {name} (title, vector, author, published_at) VALUES ('{title}', [{x}, 0, 0, 0], 'alice', {year});")
    return db.sql(f"SEARCH TOP 3 NEAREST TO [1, 0, 0, 0] FROM {name} RETURNING id, score, title;")


def _batch(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = batch_search(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _self_scores(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", dot_f64(F.col("embedding"), F.col("embedding")).alias("score"))


def _id_score(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("id"), "score")


def queries() -> dict:
    return {
        "search_top10_id_score": lambda s, d: _id_score(_top(s, d)),
        "search_default_projection": lambda s, d: _sql_read(s, d, f"SEARCH TOP 10 NEAREST TO {_literal(s, d)} FROM embeddings;"),
        "search_returning_mixed": lambda s, d: _sql_read(s, d, f"SEARCH TOP 10 NEAREST TO {_literal(s, d)} FROM embeddings RETURNING score, label, id;"),
        "search_k_exceeds_n": lambda s, d: _id_score(_top(s, d, 100000)),
        "search_filtered_eq": lambda s, d: _id_score(_top(s, d, where=lookup_eq(Column("label", "INT"), 3))),
        "search_filtered_range": lambda s, d: _id_score(_top(s, d, where=lookup_range(Column("label", "INT"), ">=", 5))),
        "search_excludes_deleted": _excludes_deleted,
        "search_ranked": _ranked,
        "select_star": lambda s, d: _sql_read(s, d, "SELECT * FROM embeddings;"),
        "select_columns_reordered": _orders_reordered,
        "lookup_eq_int": _lookup("orders", "o_custkey", "INT", 7, "o_orderkey"),
        "lookup_eq_float": _lookup("lineitem", "l_discount", "FLOAT", 0.05, "l_orderkey", "l_linenumber"),
        "lookup_eq_text": _lookup("customer", "c_mktsegment", "TEXT", "BUILDING", "c_custkey"),
        "lookup_range_lt_int": _lookup("part", "p_size", "INT", 10, "p_partkey", op="<"),
        "lookup_range_le_int": _lookup("part", "p_size", "INT", 10, "p_partkey", op="<="),
        "lookup_range_gt_int": _lookup("part", "p_size", "INT", 40, "p_partkey", op=">"),
        "lookup_range_ge_int": _lookup("part", "p_size", "INT", 40, "p_partkey", op=">="),
        "lookup_range_lt_float": _lookup("supplier", "s_acctbal", "FLOAT", 0.0, "s_suppkey", op="<"),
        "lookup_range_le_float": _lookup("lineitem", "l_tax", "FLOAT", 0.02, "l_orderkey", "l_linenumber", op="<="),
        "lookup_range_gt_float": _lookup("lineitem", "l_extendedprice", "FLOAT", 50000.0, "l_orderkey", "l_linenumber", op=">"),
        "lookup_range_ge_float": _lookup("supplier", "s_acctbal", "FLOAT", 0.0, "s_suppkey", op=">="),
        "lookup_range_text_empty": _lookup("customer", "c_mktsegment", "TEXT", "A", "c_custkey", op=">="),
        "lookup_and": _combined(True),
        "lookup_or": _combined(False),
        "live_count": lambda s, d: _alive(s, d).agg(F.count("*").alias("live_count")),
        "live_ids": lambda s, d: _alive(s, d).select("vec_id"),
        "high_water": lambda s, d: high_water(table(s, d, "embeddings"), "vec_id"),
        "scan_over_ids": _scan_over,
        "get_rows_status": _get_rows,
        "vector_at": _vector_at,
        "dot_product": _self_scores,
        "sql_create_insert_search": _sql_round_trip,
        "batch_knn": _batch,
    }


def oracle_sql() -> dict[str, str]:
    top = f"SELECT e.vec_id AS id, {_S} AS score {_FROM}"
    rank = "ORDER BY score DESC, id LIMIT 10"
    pick = "SELECT {} FROM {} WHERE {}"
    return {
        "search_top10_id_score": f"{top} {rank}",
        "search_default_projection": f"SELECT e.label::BIGINT AS label {_FROM} ORDER BY {_S} DESC, e.vec_id LIMIT 10",
        "search_returning_mixed": f"SELECT {_S} AS score, e.label::BIGINT AS label, e.vec_id AS id {_FROM} {rank}",
        "search_k_exceeds_n": f"{top} ORDER BY score DESC, id LIMIT 100000",
        "search_filtered_eq": f"{top} WHERE e.label = 3 {rank}",
        "search_filtered_range": f"{top} WHERE e.label >= 5 {rank}",
        "search_excludes_deleted": f"{top} WHERE e.vec_id % 7 <> 0 {rank}",
        "search_ranked": f"SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({top}) QUALIFY rank <= 10",
        "select_star": "SELECT label::BIGINT AS label FROM embeddings ORDER BY vec_id",
        "select_columns_reordered": "SELECT o_orderstatus, o_orderkey FROM orders",
        "lookup_eq_int": pick.format("o_orderkey", "orders", "o_custkey = 7"),
        "lookup_eq_float": pick.format("l_orderkey, l_linenumber", "lineitem", "l_discount = 0.05::DOUBLE"),
        "lookup_eq_text": pick.format("c_custkey", "customer", "c_mktsegment = 'BUILDING'"),
        "lookup_range_lt_int": pick.format("p_partkey", "part", "p_size < 10"),
        "lookup_range_le_int": pick.format("p_partkey", "part", "p_size <= 10"),
        "lookup_range_gt_int": pick.format("p_partkey", "part", "p_size > 40"),
        "lookup_range_ge_int": pick.format("p_partkey", "part", "p_size >= 40"),
        "lookup_range_lt_float": pick.format("s_suppkey", "supplier", "s_acctbal < 0"),
        "lookup_range_le_float": pick.format("l_orderkey, l_linenumber", "lineitem", "l_tax <= 0.02::DOUBLE"),
        "lookup_range_gt_float": pick.format("l_orderkey, l_linenumber", "lineitem", "l_extendedprice > 50000"),
        "lookup_range_ge_float": pick.format("s_suppkey", "supplier", "s_acctbal >= 0"),
        "lookup_range_text_empty": pick.format("c_custkey", "customer", "false"),
        "lookup_and": pick.format("o_orderkey", "orders", "o_totalprice >= 200000 AND o_orderstatus = 'F'"),
        "lookup_or": pick.format("o_orderkey", "orders", "o_totalprice >= 200000 OR o_orderstatus = 'F'"),
        "live_count": "SELECT count(*) AS live_count FROM embeddings WHERE vec_id % 7 <> 0",
        "live_ids": "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0",
        "high_water": "SELECT max(vec_id) + 1 AS high_water FROM embeddings",
        "scan_over_ids": "SELECT (p.pos - 1)::BIGINT AS pos, e.vec_id, e.label::BIGINT AS label FROM (SELECT unnest([6, 1, 4, 1, 999999]) AS vec_id, generate_subscripts([6, 1, 4, 1, 999999], 1) AS pos) p JOIN embeddings e ON e.vec_id = p.vec_id",
        "get_rows_status": "SELECT (p.pos - 1)::BIGINT AS pos, p.id::BIGINT AS id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.vec_id % 7 = 0 THEN 'deleted' ELSE 'live' END AS status, CASE WHEN e.vec_id % 7 <> 0 THEN e.label::BIGINT END AS label FROM (SELECT unnest([0, 3, 7, 12, 999999]) AS id, generate_subscripts([0, 3, 7, 12, 999999], 1) AS pos) p LEFT JOIN embeddings e ON e.vec_id = p.id",
        "vector_at": "SELECT (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id = 7",
        "dot_product": "SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings",
        "sql_create_insert_search": "SELECT * FROM (VALUES (1::BIGINT, 3.0::DOUBLE, 'near'), (2::BIGINT, 2.0::DOUBLE, 'mid'), (0::BIGINT, 1.0::DOUBLE, 'far')) t(id, score, title)",
        "batch_knn": "SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 10",
    }
