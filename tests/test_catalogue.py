"""Each core query against DuckDB on the smallest tables."""

import duckdb
import pytest

from hexavane import queries as Q
from oracle_check import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    cursor = db.execute(Q.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_plans(spark):
    """Top-k without a full sort, predicates and pruned columns at the scan."""

    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "TakeOrderedAndProject" in plan(Q.queries()["search_top10_id_score"](spark, SF))
    p = plan(Q.queries()["lookup_eq_int"](spark, SF))
    assert "EqualTo(o_custkey,7)" in p and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    assert "WindowGroupLimit" in plan(Q.queries()["batch_knn"](spark, SF))
