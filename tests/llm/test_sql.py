"""The registered queries of the subpackage against their SQL on the smallest tables."""

import os

import pytest

from palletry.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op13_drake_clusters"}))
def test_query_matches_sql(spark, con, name):
    df, sql = queries.queries()[name](spark, FOLDER), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    text = lambda rows: sorted("|".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(df.select(*sql.columns).collect()) == text(sql.fetchall())


def test_columns_named_like_the_output_give_way(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "slot long, shard string, size int")
    out = sharding.place(df, "slot", ["x", "y"], 7)
    assert out.columns == ["size", "slot", "shard"] and {r.shard for r in out.collect()} <= {"x", "y"}
    again = sharding.place(df.withColumnRenamed("slot", "key"), "key", ["x", "y"], 7).select("key", "slot", "shard").collect()
    assert {(r.slot, r.shard) for r in out.collect()} == {(r.slot, r.shard) for r in again}
