"""Runs, settings, stored populations, route files and small texts, by hand-worked values."""

import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from palletry.functions import numeric as N, text as T
from palletry.operators import cases as C, features as E, geometry as G, metrics as M, ml, population as P
from palletry.sources import io


def test_labels_are_required(spark):
    items = spark.createDataFrame([(1, 3, 2, 1), (1, 1, 2, 3), (2, 5, 5, 5)], "dispatch_id long, length int, width int, height int")
    labels = spark.createDataFrame([(1, 1)], "dispatch_id long, if_loaded int")
    with pytest.raises(Exception, match="Missing if_loaded for dispatch_id 2"):
        E.item_types(items, labels, strict=True).collect()
    types = E.item_types(items.where("dispatch_id = 1"), labels, strict=True)
    assert [tuple(r) for r in types.collect()] == [(1, 1, 1, 1, 2, 3, 2)]
    assert tuple(E.same_orders(types, labels, "dispatch_id").first()) == (1, 1)
    with pytest.raises(Exception, match="1 of 2 keys"):
        E.same_orders(types, items, "dispatch_id").collect()


def test_quantiles_by_hand(spark):
    a = [7.0, 1.0, 1.0, 4.0, 9.0, 2.5]
    rows = [(x, float("nan") if i else None) for i, x in enumerate(a)]
    r = {x.feature: x for x in E.quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    q = statistics.quantiles(a, n=4, method="inclusive")
    assert list(r) == ["a"] and (r["a"].n, r["a"].min, r["a"].max) == (6, 1.0, 9.0)
    assert [r["a"].p25, r["a"]["median"], r["a"].p75] == pytest.approx(q)
    assert E.quantiles(spark.createDataFrame([], "a double"), ["a"]).count() == 0


RULES = "rule long, score double, fn_corr long, fp_corr long, easy_overrides long, island_id int"


def test_islands_from_flat_rules_and_reset(spark):
    rows = [(1, 0.5, 1, 0, 0, 0), (2, 0.9, 1, 0, 0, 9), (3, 0.5, 2, 0, 0, -1), (4, 0.2, 0, 0, 0, 1), (5, 0.1, 0, 0, 0, 1), (6, 0.7, 0, 0, 0, 2)]
    r = P.rebuilt(spark.createDataFrame(rows, RULES), "rule", 3, 2)
    assert sorted((x.rule, x.island_id) for x in r.collect()) == [(2, 0), (3, 0), (4, 1), (5, 1), (6, 2)]
    trimmed = sorted((x.rule[:8], x.island_id) for x in P.reset_worst(r, "rule", "rule", 3, keep=1).collect())
    assert trimmed == [("2", 0), ("2_reset_", 1), ("3", 0), ("4", 1), ("6", 2)]
    cleared = sorted((x.rule[:8], x.island_id) for x in P.reset_worst(r, "rule", "rule", 3, clear=True).collect())
    assert cleared == [("2", 0), ("2_reset_", 1), ("3", 0), ("6", 2)]
    empty_island = P.reset_worst(r, "rule", "rule", 4)
    assert empty_island.where("island_id = 3").count() == 1 and empty_island.count() == 6
    assert P.reset_worst(r.where("rule < 0"), "rule", "rule", 3).count() == 0
    assert P.reset_worst(r, "rule", "rule", 1).count() == 5


def test_population_step(spark):
    kind = "code string, obj double, nth int, exec_success boolean"
    old = spark.createDataFrame([("a", 1.0000004, 0, True)], kind)
    new = spark.createDataFrame([("a", 5.0, 1, True), ("b", 1.0, 2, True), ("c", 2.0, 3, True), ("d", 2.0, 4, True), ("e", 3.0, 5, None), ("f", 9.0, 6, True)], kind)
    assert [r.code for r in P.valid(new, "obj", below=6.0).orderBy("nth").collect()] == list("abcd")
    assert sorted(r.code for r in P.joined_by(old, P.valid(new, "obj"), "code", "obj", "nth").collect()) == ["a", "c", "f"]


def test_setting_conflicts(spark):
    kv = lambda **s: spark.createDataFrame(list(s.items()), "key string, value string")
    before, now = kv(seed="1", size="0.2", mode="a", other="x"), kv(seed="1", size="0.3", mode="b", fresh="y")
    c = P.setting_conflicts(before, now, ["seed", "size"], ["mode", "fresh"])
    assert sorted((r.key, r.severity) for r in c.collect()) == [("mode", "warning"), ("size", "error")]
    with pytest.raises(Exception, match="size does not match checkpoint 0.2"):
        P.accepted_settings(c).collect()
    assert [r.key for r in P.accepted_settings(c.where("key = 'mode'")).collect()] == ["mode"]


def test_texts(spark):
    numbers = [0.0, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234, -2.5, 1e100, 999999.5, math.pi]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(T.general(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["%.6g" % x for x in numbers]
    one = spark.createDataFrame([(" SVM, ,lr,svm ,rf", "exp_20240102_030405", None)], "n string, e string, x double")
    r = one.select(T.names(F.col("n")).alias("n"), T.model_file(F.col("e")).alias("m"), T.model_file(F.col("n")).alias("none"), T.fixed(F.col("x")).alias("x"), T.fixed(F.lit(0.25), 1, sign=True).alias("p")).first()
    assert r.n == ["svm", "lr", "rf"] and r.m == "models/linear_svm_20240102_030405.json" and r.none is None and r.x is None and r.p == "+0.3"
    assert one.select(T.run_id(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("t")).first().t == "20240102_030405"
    line = T.case_line(F.lit(7), F.lit(0.25), F.lit(1), {"a": F.lit(2), "b": F.lit(None)})
    assert one.select(line.alias("t")).first().t == "dispatch=7 prob=0.2500 gt=1, a=2, b=N/A"


def test_route_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text(
        "depot,0.5,0.25,customer,0.1,0.2,0.3,0.4,capacity,30.0,demand,0,7,8,cost,1.5,node_flag,2,1,1,0\n"
        "depot,0,0,customer,1,1,capacity,20,demand,5,cost,2,node_flag,1,1\n\n"
    )
    a, b = io.read_routes(spark, str(tmp_path / "r.txt")).orderBy("line").collect()
    assert tuple(a.depot) == (0.5, 0.25) and [tuple(c) for c in a.customers] == [(0.1, 0.2), (0.3, 0.4)]
    assert (a.capacity, a.demand, a.cost) == (30, [0, 7, 8], 1.5) and [tuple(x) for x in a.node_flag] == [(2, 1), (1, 0)]
    assert b.demand == [0, 5] and [tuple(x) for x in b.node_flag] == [(1, 1)]


def test_places_of_route_fields_are_sought_once_and_lacking_ones_are_null(spark):
    odd = [" depot , 1,2 ,customer,1,2,3,capacity,7.9,demand,1,x,cost,1e3,node_flag,1,,0,1", "capacity,5,demand,0,1,cost,2,node_flag,3", None]
    lines = spark.createDataFrame(list(enumerate(odd)), "id int, text string").select("id", T.route_line(F.col("text")).alias("r"))
    got = [r.r for r in lines.orderBy("id").collect()]
    assert got[0].depot == (1.0, 2.0) and got[0].customers == [(1.0, 2.0)] and got[0].capacity == 7 and got[0].demand == [0, 1, None] and got[0].cost == 1000.0
    assert got[0].node_flag == [(1, 0), (None, 1)] and tuple(got[1]) == (None, None, 5, [0, 1], 2.0, None)
    assert tuple(got[2]) == (None,) * 6
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("array_position(") <= 6


def test_reversed_routes_keep_their_nodes(spark):
    flagged = spark.createDataFrame([(i, p, p + 1, int(p % 3 == 0)) for i in range(20) for p in range(6)], "instance long, pos int, node int, from_depot int")
    got = G.reversed_routes(flagged).collect()
    assert len(got) == 40 and {tuple(r.nodes) for r in got} == {(1, 2, 3), (3, 2, 1), (4, 5, 6), (6, 5, 4)}


def test_tsplib_file_to_gap(spark, tmp_path):
    (tmp_path / "square.tsp").write_text("NAME: square\nNODE_COORD_SECTION\n1 0 0\n2 0 20\n3 20 20\n4 20 0\nEOF\n")
    length = G.tour_length(io.read_tsplib(spark, str(tmp_path / "square.tsp")).withColumnRenamed("node", "pos"))
    known = spark.createDataFrame([("square", 3.2)], "instance string, optimum double")
    r = G.gaps(length, known).first()
    assert (r.mean, r.std) == (4.0, 0.0) and r.gap_pct == pytest.approx(25.0)


def test_overview_of_stored_runs(spark, tmp_path):
    runs = {
        "by_model/m_1/exp_1": {"svm": {"accuracy": 0.5}, "hybrid": {"accuracy": 0.75, "best_rule_score": 0.125}, "resumed": True, "resume_start_iteration": 4, "timestamp": "t"},
        "by_model/m_1/exp_2": {"llm_model": "named", "svm": {"accuracy": 0.5}},
        "exp_3": {},
    }
    for name, results in runs.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "results.json").write_text(json.dumps(results))
    got = [tuple(r) for r in M.run_overview(io.read_runs(spark, str(tmp_path))).orderBy("run").collect()]
    none = "—"
    assert got == [
        ("m_1", "exp_1", "t", "yes (from 4)", "0.5000", "0.7500", "+0.2500", "0.125000"),
        ("named", "exp_2", none, "no", "0.5000", none, none, none),
        (none, "exp_3", none, "no", none, none, none, none),
    ]


def test_columns_labels_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "x", 2)], "a int, b double, c string, d long")
    assert E.select_numeric(df, drop=("d",), first=("b",)) == ["b", "a"] and E.select_numeric(df, most=1) == ["a"]
    cases = spark.createDataFrame([(1, 0.4, 1), (1, 0.4, None)], "gt int, prob double, given int")
    assert [(r.pred, r.error_type) for r in C.classified(cases, hard="given").collect()] == [(1, "TP"), (0, "FN")]
    texts = spark.createDataFrame([(" 1.5 ",), ("",), ("nan",), ("x",), (None,)], "t string")
    assert [r.n for r in texts.select(N.missing(F.col("t")).alias("n")).collect()] == [1.5, None, None, None, None]
    r = df.select(N.logit(F.lit(0.75)).alias("l"), N.clip(F.lit(3.0), 0.0, 1.0).alias("c")).first()
    assert r.l == pytest.approx(math.log(3)) and r.c == 1.0
    trials = spark.createDataFrame([(1, 0.9, 0.1, 0.9), (2, 0.9, 0.2, 0.1), (3, 0.8, 0.9, 0.9)], "nth int, auc double, tpr1 double, accuracy double")
    assert ml.trial_table(trials).first().nth == 2
    for kind in ("parquet", "csv", "json"):
        io.write_table(df, str(tmp_path / kind), kind)
        io.write_table(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == df.collect()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns
    assert json.loads(io.report_json(df)) == {"a": 1, "b": 0.5, "c": "x", "d": 2} and io.report_json(df.where("a > 1")) == "{}"
