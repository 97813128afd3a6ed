"""Selection, splicing, deposits, renumbering, sinks and runs from files, worked out by hand."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palletry.functions import text
from palletry.operators import geometry as G, metrics as M, packing as B, population as P, rules as R, scoring as S, tours as T
from palletry.sources import io


def test_parents_come_by_their_chances(spark):
    """Three members: 1 / 4, 1 / 5 and 1 / 6 over 37 / 60; each population as a whole, the last interval closed."""
    df = spark.createDataFrame([(p, k, float(k)) for p in (1, 2, None) for k in range(3)], "population int, id int, score double")
    got = P.drawn_parents(df, ["score"], "id", ["population"], 400, 5).collect()
    assert len(got) == 3 * 2000 and {(r.draw, r.nth) for r in got} == {(a, b) for a in range(400) for b in range(5)}
    for p in (1, 2, None):
        share = Counter(r.id for r in got if r.population == p)
        for k, want in enumerate((15 / 37, 12 / 37, 10 / 37)):
            assert abs(share[k] / 2000 - want) < 4 * math.sqrt(want * (1 - want) / 2000)
    assert P.drawn_parents(df, ["score"], "id", ["population"], 400, 5).subtract(spark.createDataFrame(got)).isEmpty()


def test_better_half_and_elites(spark):
    """Odd sizes keep the larger half; ties go by id; null rewards are last; elites and children make the next population."""
    rows = [(1, i, r) for i, r in enumerate([0.5, 0.9, None, 0.9, 0.1, 0.7, 0.2])] + [(2, 9, 1.0)]
    df = spark.createDataFrame(rows, "population int, id int, reward double")
    kept = P.survivors(df, "reward", "id", ["population"], 0.3)
    assert sorted((r.population, r.rank, r.id, r.elite) for r in kept.collect()) == [(1, 1, 1, True), (1, 2, 3, True), (1, 3, 5, False), (1, 4, 0, False), (2, 1, 9, False)]
    children = spark.createDataFrame([(1, 100 + i, 0.0) for i in range(9)] + [(2, 300, 0.0)], "population int, id int, reward double")
    out = P.next_population(kept, children, "id", ["population"], 5).collect()
    assert sorted((r.population, r.id, r.origin) for r in out) == [(1, 1, "elite"), (1, 3, "elite"), (1, 100, "child"), (1, 101, "child"), (1, 102, "child"), (2, 300, "child")]
    assert P.survivors(df, "reward", "id", ["population"], 0.8).where("population = 1").count() == 5


def test_ranks_of_one_huge_group_equal_a_window(spark):
    df = spark.range(3000).select(F.lit(1).alias("g"), "id", (F.col("id") * 7919 % 101).cast("double").alias("v"))
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r.v, r.id)), 1)}
    assert {r.id: r["rank"] for r in P.ranked_within(df, ["g"], "v", "id").collect()} == want


def test_all_offspring_join_if_repeats_may(spark):
    kind = "code string, obj double, nth int"
    old, new = spark.createDataFrame([("a", 1.0, 0)], kind), spark.createDataFrame([("a", 5.0, 1), ("b", 1.0, 2), ("c", 2.0, 3), ("d", 2.0, 4), ("e", None, 5)], kind)
    got = {(r.code, r.nth): r.repeated for r in P.joined_by(old, new, "code", "obj", "nth", repeats=True).collect()}
    assert got == {("a", 0): False, ("a", 1): False, ("b", 2): True, ("c", 3): False, ("d", 4): True, ("e", 5): False}


def test_settings_compare_as_numbers(spark):
    kv = lambda **s: spark.createDataFrame(list(s.items()), "key string, value string")
    c = P.changed_settings(kv(a="0.2", b="1", c="x", d="1e3", e="7"), kv(a="0.20", b="2", c="X", d="1000", f="8"))
    assert sorted(r.key for r in c.collect()) == ["b", "c", "e", "f"]


def test_labels_are_renumbered_as_they_appear(spark):
    rows = [(1, p, b) for p, b in enumerate([7, 7, 3, 9, 3, 7])] + [(2, 5, 1), (2, 4, 2), (None, 0, None)]
    got = B.renumbered(spark.createDataFrame(rows, "instance int, pos int, bin int"), "bin", "pos", "instance").collect()
    assert sorted((r.instance or 0, r.pos, r.number, r.n_labels) for r in got) == [(0, 0, 0, 1), (1, 0, 0, 3), (1, 1, 0, 3), (1, 2, 1, 3), (1, 3, 2, 3), (1, 4, 1, 3), (1, 5, 0, 3), (2, 4, 0, 2), (2, 5, 1, 2)]


def test_splice_and_acceptance_by_hand(spark):
    """A square walked crosswise is mended, a square walked round is left alone."""
    xy = {10: (0.0, 0.0), 11: (1.0, 0.0), 12: (1.0, 1.0), 13: (0.0, 1.0)}
    places = spark.createDataFrame([(i, n, *p) for i in (1, 2) for n, p in xy.items()], "instance int, node int, x double, y double")
    tours = spark.createDataFrame([(1, p, n) for p, n in enumerate([10, 12, 11, 13])] + [(2, p, n) for p, n in enumerate([10, 11, 12, 13])], "instance int, pos int, node int")
    paths = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)], "instance int, pos int, pick int")
    after = T.spliced(tours, paths)
    assert [r.node for r in after.where("instance = 1").orderBy("pos").collect()] == [10, 11, 12, 13]
    final, report = T.accepted(tours, after, places)
    assert {r.instance: (round(r.before, 3), round(r.after, 3), r.taken) for r in report.collect()} == {1: (4.828, 4.0, True), 2: (4.0, 4.828, False)}
    assert [r.node for r in final.orderBy("instance", "pos").collect()] == [10, 11, 12, 13] * 2
    with pytest.raises(Exception, match="not a permutation"):
        T.spliced(tours, spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "instance int, pos int, pick int")).collect()


def test_deposit_and_evaporation_by_hand(spark):
    state = spark.createDataFrame([(1, 1, 2, 2.0), (1, 3, 4, 5.0)], "instance int, u int, v int, value double")
    tours = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 0, 2, 3)], "instance int, tour int, pos int, node int")
    costs = spark.createDataFrame([(1, 0, 4.0)], "instance int, tour int, cost double")
    got = {(r.u, r.v): round(r.value, 9) for r in T.deposited(state, tours, costs, 0.5, 1.0).collect()}
    assert got == {(1, 2): 1.25, (2, 1): 0.75, (2, 3): 0.75, (3, 2): 0.75, (3, 1): 0.75, (1, 3): 0.75, (3, 4): 2.5}


def test_other_forms_of_a_solution_keep_routes(spark):
    rows = [(i, p, n, f) for i in range(30) for p, (n, f) in enumerate([(5, 1), (6, 0), (7, 0), (8, 1), (9, 1), (10, 0)], 1)]
    flags = spark.createDataFrame(rows, "instance int, pos int, node int, from_depot int")

    def routes(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r.instance, r.pos)):
            own = out.setdefault(r.instance, [])
            if r.from_depot:
                own.append([])
            own[-1].append(r.node)
        return out

    plain = [[5, 6, 7], [8], [9, 10]]
    turned = routes(T.inverted(flags))
    assert all([sorted(r) for r in v] == plain and all(r in (sorted(r), sorted(r)[::-1]) for r in v) for v in turned.values())
    assert {v[0][0] for v in turned.values()} == {5, 7}
    shifted = routes(T.shifted(flags))
    back = [r[::-1] for r in plain[::-1]]
    forms = [form[k:] + form[:k] for form in (plain, back) for k in range(3)]
    assert all(v in forms for v in shifted.values()) and len({str(v) for v in shifted.values()}) == 6
    assert {str(v) for v in routes(T.shifted(flags, turn=False)).values()} == {str(plain[k:] + plain[:k]) for k in range(3)}
    demand = spark.createDataFrame([(i, n, n) for i in range(30) for n in range(5, 11)], "instance int, node int, demand int")
    loads = lambda df: sorted((r.instance, r.load) for r in G.routes(df, demand, 100.0).collect())
    assert loads(flags) == loads(T.inverted(flags)) == loads(T.shifted(flags))
    assert [r.c for r in spark.createDataFrame([(10,), (1000,), (11,)], "n int").select(T.route_capacity(F.col("n")).alias("c")).collect()] == [20.0, 250.0, None]


def test_failures_of_responses(spark):
    fence = "```"
    responses = [f"{fence}python\nx = 1\n{fence}", f"{fence}py\nunclosed", "plain\n", None, f"{fence}python\ndef apply_rule_patch(p, f):\n  return 1\n{fence}"]
    got = [r.i for r in spark.createDataFrame(list(enumerate(responses)), "n int, t string").orderBy("n").select(text.failure_info(F.col("t"), most=5).alias("i")).collect()]
    assert [g and g.detail for g in got] == ["python_blocks_without_apply_rule_patch", "has_open_python_fence_no_close", "no_python_fence", "no_python_fence", None]
    assert got[0].message.startswith("Found 1 closed") and got[2].preview == "plain" and got[3].preview == "" and got[0].preview == "```py" + text.TRUNCATED


def test_models_and_rules_read_back_equal(spark, tmp_path):
    model = S.LinearModel((("a", 0.0, 2.0, -1.5), ("b", 1.0, 4.0, 0.25)), 0.75)
    io.write_linear_model(spark, model.features, model.intercept, str(tmp_path / "m"))
    assert S.LinearModel.from_table(io.read_linear_model(spark, str(tmp_path / "m"))) == model
    rules = spark.createDataFrame([("r1", "def f():\n  pass", 1, 2, 3, 4, 0.5, [0.1, 0.5], 2, 7), ("r2", "é", 0, 0, 0, 0, 0.0, [], 0, 0)], io.RULES)
    io.write_rules(rules, str(tmp_path / "r"))
    assert sorted(io.read_rules(spark, str(tmp_path / "r"), lines=True).collect()) == sorted(rules.collect())
    top = S.top_coefficients(spark.createDataFrame([(0, "a", 1.0), (1, "b", -3.0), (2, "c", 3.0), (3, "d", 0.5)], "nth int, feature string, weight double"), 3)
    assert [tuple(r) for r in top.orderBy("rank").collect()] == [(1, "b", -3.0), (2, "c", 3.0), (3, "a", 1.0)]


def test_runs_and_rule_counts_from_files(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(value))

    put("by_model/m1/exp_1/results.json", {"svm": {"accuracy": 0.5}, "hybrid": {"accuracy": 0.75, "best_rule_score": 0.125}, "timestamp": "20240101"})
    put("by_model/m1/exp_1/evolved_rules.json", [{"id": "a"}, {"id": "b"}])
    put("by_model/m2/deep/exp_2/results.json", {"llm_model": "named"})
    put("by_model/m2/deep/exp_2/evolved_rules.json", {"no": "list"})
    put("by_model/m3/trial/results.json", {})
    put("exp_4/results.json", {})
    runs = io.with_rule_counts(io.experiments(io.read_runs(spark, str(tmp_path))), str(tmp_path))
    assert sorted((r.run, r.n_rules) for r in runs.collect()) == [("exp_1", 2), ("exp_2", None)]
    got = {r.run: r for r in M.run_overview(runs).collect()}
    assert (got["exp_1"].model, got["exp_1"].delta, got["exp_1"].n_rules) == ("m1", "+0.2500", 2) and got["exp_2"].model == "named"
    report = M.markdown(M.run_overview(runs.where("run = 'exp_1'")).select("model", "n_rules", "delta"), "Runs")
    assert report == "# Runs\n\n|model|n_rules|delta|\n|-|-|-|\n|m1|2|+0.2500|\n"
    with pytest.raises(ValueError):
        M.markdown(spark.range(5), "x", 4)


def test_masks_and_best_rules(spark):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(["FN", "FP", "TN", "TP"])], "id int, e string")
    fn, fp = F.col("e") == "FN", F.col("e") == "FP"
    assert [M.hard_rows(df, a, b).count() for a, b in ((fn, fp), (None, fp), (None, None))] == [2, 1, 4]
    with pytest.raises(ValueError):
        M.hard_rows(df, fn)
    ranks = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3), ("w", 4)], "rule string, rank int")
    best = R.best_rules(ranks, {"x": F.lit(-1), "y": F.lit(1), "z": None, "w": F.lit(0)}, 3)
    assert len(best) == 2 and R.applied(df.withColumn("pred", F.lit(0)), best).first().hybrid == 1
    assert R.applied(df.withColumn("pred", F.lit(0)), []).first().hybrid == 0


@pytest.mark.parametrize("priority", ["best_fit", "first_fit", "score_step"])
def test_online_packing_in_pieces_equals_a_plain_loop(priority):
    """Items in pieces of any length give the bins of a loop over all bins, zero and too large items included."""
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(12):
        items = np.array([rng.choice([0.0, 101.0, *range(1, 101), *range(1, 30)]) for _ in range(rng.randint(1, 90))], float)
        if priority == "score_step":
            items = items[items > 0]
        room, want = np.full(len(items), 100.0), []
        for item in items:
            fits = np.flatnonzero(room >= item)
            b = int(fits[np.argmax(B.PRIORITIES[priority](item, room[fits]))]) if len(fits) else -1
            want.append(b)
            if b >= 0:
                room[b] -= item
        state, got, at = B.packer(100.0, priority), [], 0
        while at < len(items):
            n = rng.randint(1, 9)
            got += state.pack(items[at : at + n]).tolist()
            at += n
        assert got == want


def test_one_instance_of_most_items_streams_through_its_task(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 50).cast("long").alias("instance"), "id", (F.col("id") * 37 % 100 + 1).cast("double").alias("item")).withColumnRenamed("id", "seq")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = B.online(df, 100.0).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k in {r.instance for r in got}:
        own = [r for r in got if r.instance == k]
        assert [r.bin for r in own] == B.pack_online([r.item for r in own], 100.0).tolist()


def _masks(nodes, demand, capacity, depot):
    """A loop over one rollout: (load, seen, finished, allowed) of each step, and what may follow."""
    load, seen, at, done, out = capacity, set(), None, False, []

    def mask(node):
        if at is None:
            return node in demand or node == depot
        if done:
            return node == depot
        if node == depot:
            return at != depot and load + 1e-5 >= 0
        return node in demand and node not in seen and load + 1e-5 >= demand[node]

    for node in nodes:
        ok = mask(node)
        load, at = capacity if node == depot else load - demand.get(node, 0), node
        seen |= {node} & demand.keys()
        done = done or len(seen) == len(demand) and (depot is None or at == depot)
        out.append((load, len(seen), done, ok))
    return out, {k: mask(k) for k in [*demand, *([] if depot is None else [depot])]}


@pytest.mark.parametrize("depot", [0, None])
def test_rollouts_equal_a_loop(spark, depot):
    """Whole and broken rollouts: early ends, repeats, overloads, unknown nodes, the depot twice, steps after the end."""
    demand = {1: {1: 4.0, 2: 5.0, 3: 7.0}, 2: {1: 10.0, 5: 0.00001}, 3: {4: 11.0}}
    tours = {
        (1, 0): [0, 1, 2, 0, 3, 0, 0], (1, 1): [1, 3, 0, 0, 2, 2], (1, 2): [0, 3, 2, 1, 0, 0, 1], (1, 3): [2], (1, 4): [3, 2, 1, 1], (1, 5): [0, 9, 1, 9, 0],
        (2, 0): [0, 1, 5, 0], (2, 1): [5, 1], (3, 0): [0, 4, 0], (3, 1): [0, 0, 4], (7, 0): [0, 1],
    }
    steps = spark.createDataFrame([(i, t, 10 * p, n) for (i, t), nodes in tours.items() for p, n in enumerate(nodes)], "instance int, tour int, pos int, node int")
    stops = spark.createDataFrame([(i, n, x) for i, s in demand.items() for n, x in s.items()], "instance int, node int, demand double")
    want = {k: _masks(v, demand[k[0]], 10.0, depot) for k, v in tours.items() if k[0] in demand}
    got = {}
    for r in sorted(T.replayed(steps, stops, 10.0, depot).collect()):
        got.setdefault((r.instance, r.tour), []).append((r.load, r.seen, r.finished, r.allowed))
    assert got.keys() == want.keys()
    for k, rows in got.items():
        assert [(round(a, 9), *b) for a, *b in rows] == [(round(a, 9), *b) for a, *b in want[k][0]], k
    masks = {}
    for r in T.choices(steps, stops, 10.0, depot).collect():
        masks.setdefault((r.instance, r.tour), {})[r.node] = r.allowed
    assert masks == {k: v[1] for k, v in want.items()}
    assert T.replayed(steps.limit(0), stops, 10.0, depot).isEmpty() and T.choices(steps, stops.limit(0), 10.0, depot).isEmpty()
