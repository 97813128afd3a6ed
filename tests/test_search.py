import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palletry.operators import geometry as G, packing as B, search as S


@pytest.fixture(scope="module")
def xy():
    return np.random.default_rng(0).random((30, 2))


def test_tours_are_permutations_and_improve(xy):
    d = S.distances(xy)
    first = S.nearest_neighbour(d)
    better = S.improve(d, first)
    guided = S.guided(d, d, rounds=5)
    for t in (first, better, guided, S.constructive(d)):
        assert sorted(t.tolist()) == list(range(30))
    assert S.length_of(d, better) <= S.length_of(d, first) and S.length_of(d, guided) <= S.length_of(d, better) + 1e-9


def test_online_packing_is_valid():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 101, 200).astype(float)
    for name in B.PRIORITIES:
        bins = B.pack_online(items, 100.0, name)
        load = np.bincount(bins, items)
        assert (load <= 100).all() and len(load) >= np.ceil(items.sum() / 100)
    assert B.pack_online(np.array([101.0, 5.0]), 100.0).tolist() == [-1, 0]


def test_score_step_by_hand():
    """Rooms 100, 100, 100 and an item of 40: the scores are equal, so the steps are one negative and two zeros: the second bin wins."""
    assert math.isclose(B.score_step(40.0, np.array([100.0, 100.0, 100.0]))[0], -(100**2 / 40**2 + 100**2 / 40**3))
    assert B.pack_online(np.array([40.0, 40.0, 60.0]), 100.0, "score_step").tolist()[0] == 1


def test_spare_bins_are_enough():
    """With all bins in view from the start, every item goes to the same bin."""
    rng = np.random.default_rng(5)
    for name, score in B.PRIORITIES.items():
        items = rng.integers(1, 101, 120).astype(float)
        room, want = np.full(len(items), 100.0), []
        for item in items:
            fits = np.flatnonzero(room >= item)
            want.append(int(fits[np.argmax(score(item, room[fits]))]))
            room[want[-1]] -= item
        assert B.pack_online(items, 100.0, name).tolist() == want


def test_depot_flags_of_the_documented_example(spark):
    tour = [0, 1, 2, 3, 0, 4, 5, 6, 0, 7, 8, 9, 10, 0]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(tour)], "instance long, pos long, node long")
    rows = G.depot_flags(df).orderBy("pos").collect()
    assert [r.node for r in rows] == list(range(1, 11)) and [r.from_depot for r in rows] == [1, 0, 0, 1, 0, 0, 1, 0, 0, 0]
    routes = G.routes(G.depot_flags(df), spark.createDataFrame([(1, n, 1.0) for n in range(1, 11)], "instance long, node long, demand double"), 3.0)
    assert {r.route: (r.load, r.legal) for r in routes.collect()} == {1: (3.0, True), 2: (3.0, True), 3: (4.0, False)}


def test_square_tour_and_neighbours(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 1.0, 1.0), (1, 3, 1.0, 0.0)], "instance long, node long, x double, y double")
    assert G.tour_length(df.withColumnRenamed("node", "pos")).first().length == 4.0
    assert G.augmented(df).select("turn").distinct().count() == 8
    near = G.nearest_nodes(df, 1).where("u = 0").first()
    assert near.v == 1
    assert G.pairwise(df, 1e-5).where("u = v").select(F.max("d")).first()[0] == 1e-5
    best = {r.node: r.prize for r in G.prizes(df).collect()}
    assert best[2] == 1.0 and best[0] == 0.01
    nodes = G.random_nodes(spark, 3, 5)
    assert nodes.count() == 15 and nodes.where("x < 0 or x >= 1").count() == 0


def test_stream_packs_like_the_batch(spark, tmp_path):
    from palletry.streaming import online

    rng = np.random.default_rng(5)
    rows = [(i % 3, i, float(v)) for i, v in enumerate(rng.integers(1, 101, 60))]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "instance long, seq long, item double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("instance long, seq long, item double").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = online.packed_stream(stream, 100.0).writeStream.outputMode("append").format("memory").queryName("packed_stream").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.instance, r.seq): r.bin for r in spark.table("packed_stream").collect()}
    want = {(r.instance, r.seq): r.bin for r in B.online(spark.createDataFrame(rows, "instance long, seq long, item double"), 100.0).collect()}
    assert got == want
    log = spark.createDataFrame([(1, True, 0.2), (2, False, 0.1), (3, True, 0.9)], "iteration long, step_ok boolean, best_score double")
    r = online.best_so_far(log).first()
    assert (r.best_score, r.iteration, r.steps, r.failures) == (0.9, 3, 3, 1)


def test_instances_are_dealt_to_many_tasks(spark):
    from palletry.operators import search

    nodes = spark.range(400).selectExpr("floor(id / 10) as instance", "id as node", "rand(1) as x", "rand(2) as y")
    tours = search.tours(nodes, "nearest").withColumn("task", F.spark_partition_id())
    assert tours.select("task").distinct().count() > 15 and tours.count() == 400


def test_guided_search_takes_many_instances_at_a_time(spark, monkeypatch):
    """Each instance's tour is that of a search on it alone; few nodes, equal and unknown places end too."""
    rng = np.random.default_rng(7)
    d = np.stack([S.distances(rng.random((9, 2))) for _ in range(30)] + [np.zeros((9, 9)), np.full((9, 9), np.nan)])
    got = S.guided_many(d, d, 20, 30)
    assert all(got[i].tolist() == S.guided(d[i], d[i], 20, 30).tolist() and sorted(got[i].tolist()) == list(range(9)) for i in range(32))
    assert all(S.length_of(a, t) <= S.length_of(a, S.improve(a, S.nearest_neighbour(a))) + 1e-9 for a, t in zip(d[:30], got))
    order = S.guided_many(d[::-1], d[::-1], 20, 30)[::-1]
    assert order.tolist() == got.tolist()
    for n in range(1, 6):
        a = S.distances(rng.random((n, 2)))
        assert sorted(S.guided(a, a, 5).tolist()) == list(range(n))
    calls, many = [], S.guided_many
    monkeypatch.setattr(S, "guided_many", lambda d, g: (calls.append(len(d)), many(d, g, 3, 30))[1])
    nodes = [(i, 10 * i + k, *map(float, rng.random(2))) for i in range(24) for k in range(6 + i % 2)]
    frames = [p for _, p in pd.DataFrame(nodes, columns=["instance", "node", "x", "y"]).groupby("instance")]
    out = pd.concat(S._guided_tours(frames))
    assert sorted(calls) == [12, 12] and sorted(map(tuple, out[["instance", "node"]].to_numpy().tolist())) == sorted(r[:2] for r in nodes)


def test_guided_tours_of_all_instances(spark):
    """Instances that Arrow's batches cut in two stay whole."""
    nodes = spark.range(600).selectExpr("floor(id / 4) as instance", "id as node", "rand(1) as x", "rand(2) as y")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = S.tours(nodes, "guided").groupBy("instance").agg(F.count_distinct("node").alias("n"), F.max("pos").alias("last")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.instance, r.n, r["last"]) for r in out} == {(i, 4, 3) for i in range(150)}
