"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from palletry.plans.oracle import ORACLE
from palletry.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(rows, order):
    def one(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted("|".join(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    sql = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    a = plain(df.collect(), sorted(range(len(df.columns)), key=lambda i: df.columns[i]))
    b = plain(sql.fetchall(), sorted(range(len(sql.columns)), key=lambda i: sql.columns[i]))
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["item_type_counts", "typical_feasibility_errors", "route_segmentation", "rollout_replay"])
def test_tasks_grow_with_the_table_and_change_nothing(spark, con, name, monkeypatch):
    from palletry.sources import io

    monkeypatch.setattr(io, "TASK_ROWS", 500)
    df, sql = QUERIES[name](spark, FOLDER), con.sql(ORACLE[name])
    order = sorted(df.columns)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert plain(rows, [df.columns.index(c) for c in order]) == plain(sql.fetchall(), [sql.columns.index(c) for c in order])
    if name == "item_type_counts":
        assert rows == sorted(rows, key=lambda r: (r.dispatch_id, r.dim_s, r.dim_m, r.dim_l))
