import json

import pytest
from pyspark.sql import functions as F

from palletry.functions import text as T
from palletry.operators import features as E, feasibility as Z, geometry as G, packing as B, population as P, splits as X
from palletry.sources import io


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(11)], "v double, y int")
    got = {r.bin: r.n for r in E.equal_width_bins(df, "v", "y").collect()}
    assert got == {1: 2, **{i: 1 for i in range(2, 11)}}
    assert E.equal_width_bins(df.withColumn("v", F.lit(3.0)), "v", "y").first().bin == 1


def test_describe_uses_sample_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "x double")
    r = E.describe(df, ["x"]).first()
    assert (r.n, r.min, r.p25, r.median, r.p75, r.max) == (4, 1.0, 1.75, 2.5, 3.25, 4.0) and abs(r.std - 1.2909944) < 1e-6


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, None), (2, 4, "c"), (1, 5, None)], "k long, r long, v string")
    assert {r.k: r.v for r in E.keep_first(df, ["k"], ["r"]).collect()} == {1: "a", 2: None}
    assert {r.k: r.v for r in E.last_known(df, "k", "v", "r").collect()} == {1: "b", 2: "c"}
    d = E.with_default(spark.range(1, 4).withColumnRenamed("id", "k"), E.last_known(df, "k", "v", "r"), "k", "v", "none")
    assert {r.k: r.v for r in d.collect()} == {1: "b", 2: "c", 3: "none"}


def boxes(spark, rows):
    return spark.createDataFrame(rows, "dispatch_id long, seq long, length double, width double, height double")


def test_every_feasibility_reason(spark):
    rows = [(1, 0, 61.0, 1.0, 1.0), (2, 0, 60.0, 25.0, 30.0), (2, 1, 10.0, 10.0, 10.0), (3, 0, 60.0, 25.0, 29.5), (4, 0, 10.0, 10.0, 10.0)]
    rows += [(5, i, 5.0, 5.0, 5.0) for i in range(40)]
    rows += [(6, 0, 59.0, 24.0, 30.0), (6, 1, 10.0, 8.0, 5.0)]
    rows += [(7, i, 30.0, 25.0, 29.0) for i in range(2)]
    rows += [(8, i, 30.0, 26.0, 4.1) for i in range(12)] + [(8, 20, 3.0, 3.0, 3.0)]
    rows += [(9, 0, 60.0, 25.0, 30.0), (9, 1, 61.0, 1.0, 1.0)]
    got = {r.dispatch_id: r.reason for r in Z.with_reason(Z.order_features(boxes(spark, rows))).collect()}
    assert got[1] == "single_item_dimension_exceed" and got[2] == "volume_overflow_early" and got[3] == "volume_overflow_98pct" and got[4] == "pass"
    assert got[5] == "variance_compensated_fragmentation" and got[6] == "high_fill_max_dim_block" and got[7] == "high_fill_connectivity_block" and got[8] == "extreme_dimension_distribution"
    turned = [(9, 0, 61.0, 1.0, 1.0), (9, 1, 60.0, 25.0, 30.0)]
    assert got[9] == "single_item_dimension_exceed"
    assert Z.with_reason(Z.order_features(boxes(spark, turned))).first().reason == "single_item_dimension_exceed"


def test_item_types_are_canonical(spark):
    rows = [(1, 3, 1, 2), (1, 1, 2, 3), (1, 5, 5, 5), (2, 1, 1, 1), (3, 9, 9, 9)]
    items = spark.createDataFrame(rows, "dispatch_id long, length int, width int, height int")
    got = sorted(tuple(r) for r in E.item_types(items, spark.createDataFrame([(1, 1), (2, 0)], "dispatch_id long, if_loaded int")).collect())
    assert got == [(1, 1, 2, 1, 2, 3, 2), (1, 1, 2, 5, 5, 5, 1), (2, 0, 1, 1, 1, 1, 1)]


def test_error_report_of_no_orders(spark):
    judged = Z.with_reason(Z.order_features(boxes(spark, [(1, 0, 1.0, 1.0, 1.0)]))).withColumn("gt", F.lit(1)).where("false")
    r = Z.error_report(judged).first()
    assert r.n == 0 and r.fn_pct == 0.0


def test_folds_are_balanced(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    counts = {(r.y, r.fold): r.n for r in X.stratified_folds(df, "id", "y", 4).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        own = [n for (k, _), n in counts.items() if k == y]
        assert len(own) == 4 and max(own) - min(own) <= 1
    again = X.stratified_folds(df.repartition(7), "id", "y", 4)
    assert sorted(map(tuple, again.select("id", "fold").collect())) == sorted(map(tuple, X.stratified_folds(df, "id", "y", 4).select("id", "fold").collect()))


def test_selection_weights(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, float("inf")), (4, 1.0), (5, None)], "i long, o double")
    assert [r.i for r in P.unique_smallest(df, "o", "i", 5).collect()] == [2, 1]
    w = P.rank_weights(df.where("i < 3"), ["o"]).orderBy("rank").collect()
    assert abs(w[0].probability - (1 / 3) / (1 / 3 + 1 / 4)) < 1e-12 and P.elitist(df, "o", "i").first().i == 2
    assert P.pair_diversity(spark.createDataFrame([(1, "ab"), (2, "bc"), (3, "")], "i long, c string"), "i", "c").where("a = 1 and b = 2").first().distance == pytest.approx(2 / 3)


def test_weighted_sample_prefers_weight(spark):
    df = spark.range(400).withColumn("w", F.when(F.col("id") < 200, 9.0).otherwise(1.0))
    got = [r.id for r in P.weighted_sample(df, "w", "id", 100).collect()]
    assert len(set(got)) == 100 and sum(i < 200 for i in got) > 70


def test_packing_checks(spark):
    items = spark.createDataFrame([(1, 0, 60.0), (1, 1, 50.0), (1, 2, 40.0), (2, 0, 10.0)], "instance long, seq long, item double")
    packed = B.online(items, 100.0)
    assert {(r.instance, r.seq): r.bin for r in packed.collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0}
    assert all(r.valid for r in B.validity(items, packed, 100.0).collect())
    assert not B.validity(items, packed.where("seq > 0"), 100.0).where("instance = 1").first().same_items
    assert not B.validity(items, packed.withColumn("bin", F.lit(0)), 100.0).where("instance = 1").first().fits
    assert {r.instance: r.bound for r in B.lower_bound(items, 100.0).collect()} == {1: 2, 2: 1}


def test_code_texts(spark):
    fixed = "def apply_rule_patch(p, f):"
    responses = [f"text\n```python\n{fixed}\n    return 1\n```\nmore", f"```py\n{fixed}\n    return 0\n```", f"```python\n{fixed}\n    return -1", f"```\n{fixed} return 1\n```", "no code", "```python\nx = 1\n```", ""]
    RESPONSES = list(enumerate(responses, 1))
    r = {x.id: x.c for x in spark.createDataFrame(RESPONSES, "id long, t string").select("id", T.rule_code(F.col("t")).alias("c")).collect()}
    assert [len(r[i]) for i in range(1, 8)] == [1, 1, 1, 1, 0, 0, 0] and r[3][0].endswith("return -1") and r[2][0].endswith("return 0")
    df = spark.createDataFrame([("x\ndef a():\n  b\n  return np.c\nd",), ("```python\nq\n```",), ("none",)], "t string")
    assert [x.c for x in df.select(T.generated_code(F.col("t")).alias("c")).collect()] == ["import numpy as np\ndef a():\n  b\n  return np.c", "q", None]
    body = spark.createDataFrame([("import x\ndef f():\n  a\nreturn b\nc",)], "t string").select(T.body_lines(F.col("t")).alias("c")).first().c
    assert body == "  a\nreturn b"
    one = spark.createDataFrame([("<start> hello <end>", " My model/v1 ")], "t string, m string").select(T.description(F.col("t")).alias("d"), T.slug(F.col("m")).alias("s"), T.truncated(F.col("m"), 3).alias("u")).first()
    assert one.d == "hello" and one.s == "My_model_v1" and one.u.startswith("My ") and "truncated" in one.u
    # Expected values are those of stripping all white space, replacing separators one by one and keeping an empty block.
    cases = [("<start>\n hello\n<end>", "hello"), ("<start>\t a b \r\n```python\nx```", "a b"), ("none", None)]
    assert [r.d for r in spark.createDataFrame([(c,) for c, _ in cases], "t string").select(T.description(F.col("t")).alias("d")).collect()] == [w for _, w in cases]
    names = [("\n a::b//c d\t\n e+f(1) ", "a__b__c_d_e+f(1)"), (" \u00a0\n", "unknown_model"), ("x\\y", "x_y"), (None, "unknown_model")]
    assert [r.s for r in spark.createDataFrame([(n,) for n, _ in names], "n string").select(T.slug(F.col("n")).alias("s")).collect()] == [w for _, w in names]
    cut = spark.createDataFrame([("\n abc \n",), ("\t",), (None,)], "t string").select(T.truncated(F.col("t"), 3).alias("a"), T.truncated(F.col("t"), 2).alias("b"), T.truncated(F.col("t"), 0).alias("c")).collect()
    assert [tuple(r) for r in cut] == [("abc", "ab\n\n… [truncated]", ""), ("", "", ""), ("", "", "")]
    empty = spark.createDataFrame([("```python\n```\ndef a():\n  return 1",)], "t string").select(T.generated_code(F.col("t")).alias("c")).first()
    assert empty.c == ""


def test_tour_limits(spark):
    n = [50, 51, 100, 101, 200, 201, 300, 301]
    got = spark.createDataFrame([(i,) for i in n], "n int").select(G.max_length(F.col("n")).alias("m")).collect()
    assert [r.m for r in got] == [3.0, 4.0, 4.0, 5.0, 5.0, 6.0, 6.0, 7.0]


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("length,extra,dispatch_id,height,width\n5,x,900,7,6\n", encoding="utf-8")
    assert io.read_csv(spark, str(tmp_path / "a"), io.ITEM_ROWS).collect() == [(900, 5, 6, 7)]
    (tmp_path / "b.csv").write_text("length,dispatch_id\n5,900\n", encoding="utf-8")
    with pytest.raises(ValueError, match="height"):
        io.read_csv(spark, str(tmp_path / "b.csv"), io.ITEM_ROWS)
    (tmp_path / "a" / "2.csv").write_text("dispatch_id,extra,length,height,width\n900,x,5,7,6\n", encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        io.read_csv(spark, str(tmp_path / "a"), io.ITEM_ROWS).collect()


def test_leaf_tokens(spark):
    from palletry.operators import ml

    df = spark.range(200).selectExpr("id", "cast(id % 20 as double) as a", "cast(id % 20 > 12 as int) as y")
    known = ml.leaf_tokens(df.where("a < 10 or a > 14"), ["a"], "id", "y", trees=3, depth=3)
    stats = ml.leaf_stats(known).collect()
    for tree in range(3):
        own = sorted((r.token, r.leaf) for r in stats if r.tree == tree)
        assert own[0][1] is None and [x for _, x in own[1:]] == sorted(x for _, x in own[1:])
    assert sorted(r.token for r in stats) == list(range(len(stats)))
    assert all(1e-4 <= r.pos_rate <= 1 - 1e-4 for r in stats) and all(r.log_count == 0 for r in stats if r.leaf is None)
    few = ml.leaf_tokens(df.where("a = 3"), ["a"], "id", "y", trees=2, depth=2, of=df)
    assert few.where("token < unknown").count() == 0 and few.count() == 400


def test_leaf_stats_of_cells_are_those_of_rows(spark):
    from palletry.operators import ml

    df = spark.range(600).selectExpr("id", "cast(id % 20 as double) as a", "cast(id % 9 as double) as b", "cast(id % 20 + id % 7 > 14 as int) as y")
    cells = ml.cell_tokens(df, ["a", "b"], "y", trees=4, depth=4)
    assert cells.count() <= 4 * 20 * 9 * 2 and cells.where("tree = 1").agg({"n": "sum"}).first()[0] == 600
    a = ml.leaf_stats(cells, "n").orderBy("token").collect()
    b = ml.leaf_stats(ml.leaf_tokens(df, ["a", "b"], "id", "y", trees=4, depth=4)).orderBy("token").collect()
    assert a == b and len(a) > 20


def test_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("﻿order_id,distance_to_hyperplane,predicted_label,actual_label,prediction_probability,is_false_positive,is_false_negative,error_type\n7,-0.5,0,1,0.4,False,True,false_negative\n", encoding="utf-8")
    r = io.read_csv(spark, str(tmp_path / "e.csv"), io.ERROR_ROWS).first()
    assert r.order_id == 7 and r.error_type == "false_negative"
    (tmp_path / "m.json").write_text(json.dumps({"scaler_min": [0.0, 1.0], "scaler_max": [1.0, 1.0], "feature_names": ["a", "b"], "drop_cols": [], "coef": [[2.0, 3.0]], "intercept": [0.5], "model_C": 10.0}))
    from palletry.operators.scoring import LinearModel

    model = LinearModel.from_table(io.read_linear_model(spark, str(tmp_path / "m.json")))
    assert model.features == (("a", 0.0, 1.0, 2.0), ("b", 1.0, 1.0, 3.0)) and model.intercept == 0.5
    assert model.scored(spark.createDataFrame([(0.5, 2.0)], "a double, b double")).first().decision == 0.5 + 1.0 + 3.0
    (tmp_path / "r.json").write_text(json.dumps([{"id": "x", "code": "c", "score": 0.5}]))
    assert io.read_rules(spark, str(tmp_path / "r.json")).first().easy_overrides == 0
    run = tmp_path / "runs" / "exp_1"
    run.mkdir(parents=True)
    (run / "results.json").write_text(json.dumps({"svm": {"name": "svm", "accuracy": 0.9}}))
    assert [(x.run, x.svm.accuracy) for x in io.read_runs(spark, str(tmp_path / "runs")).collect()] == [("exp_1", 0.9)]
    for n in (3, 11):
        (run / f"rules_iter_{n:03d}.md").write_text("x")
    assert io.last_snapshot(spark, str(run)).first().iteration == 11
    (tmp_path / "t.tsp").write_text("NAME: t\nTYPE: TSP\nDIMENSION: 2\nNODE_COORD_SECTION\n1 10 20\n2 30 25\nEOF\n")
    assert [tuple(x) for x in io.read_tsplib(spark, str(tmp_path / "t.tsp")).orderBy("node").collect()] == [("t", 1, 0.0, 0.0), ("t", 2, 1.0, 0.25)]
    (tmp_path / "tours.txt").write_text("0.1 0.2 0.3 0.4 output 2 1 2\n")
    assert [(x.pos, x.node, x.x) for x in io.read_tours(spark, str(tmp_path / "tours.txt")).orderBy("pos").collect()] == [(0, 2, 0.3), (1, 1, 0.1), (2, 2, 0.3)]
    io.append_progress(spark.createDataFrame([(1, True, 0.5)], "iteration long, step_ok boolean, best_score double"), str(tmp_path / "log"))
    io.append_progress(spark.createDataFrame([(2, False, 0.7)], "iteration long, step_ok boolean, best_score double"), str(tmp_path / "log"))
    assert spark.read.schema(io.PROGRESS).json(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        io.require_columns(spark.range(1), ["nope"])
