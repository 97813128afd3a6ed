"""Running folds and island sums leave no window over a whole group."""

import re

from pyspark.sql import functions as F

from palletry.operators import population as P


def windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]


def test_running_folds_over_one_hot_group(spark):
    rows = [(None if i % 50 == 7 else i, None if i % 9 == 4 else (i * 37) % 101, "hot" if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "at long, score long, kind string").where("at is not null")
    best = P.running_best(df, "at", "score", "kind")
    total = P.running_total(df, "at", "score", "kind")
    for got, name, fold in ((best, "best", max), (total, "total", sum)):
        assert got.columns == ["at", "score", "kind", name]
        found = {r["at"]: r[name] for r in got.collect()}
        seen = {}
        for at, score, kind in sorted(r for r in rows if r[0] is not None):
            seen.setdefault(kind, []).extend([score] if score is not None else [])
            assert found.pop(at) == (fold(seen[kind]) if seen[kind] else None)
        assert not found
        assert any("_part" in w for w in windows(got))


def test_boltzmann_has_no_window(spark):
    df = spark.range(100).select("id", (F.col("id") % 7 / 3).alias("score"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("island"))
    got = P.boltzmann(df, "score", 0.5)
    assert got.columns == ["id", "score", "island", "probability"] and got.count() == 100
    assert all(abs(r.s - 1) < 1e-9 for r in got.groupBy("island").agg(F.sum("probability").alias("s")).collect())
    assert not windows(got)
