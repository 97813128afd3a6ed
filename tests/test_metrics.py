import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palletry.functions import numeric as N
from palletry.operators import cases as C, metrics as M, rules as R
from palletry.operators.scoring import LinearModel


def roc_by_hand(rows):
    points = [(0, 0)]
    for s in sorted({s for _, s in rows}, reverse=True):
        points.append((sum(y == 0 and p >= s for y, p in rows), sum(y == 1 and p >= s for y, p in rows)))
    return points


@pytest.fixture(scope="module")
def ten(spark):
    rows = [(1, 1, 0.9), (2, 1, 0.8), (3, 0, 0.8), (4, 1, 0.5), (5, 0, 0.5), (6, 1, 0.4), (7, 0, 0.3), (8, 0, 0.3), (9, 1, 0.1), (10, 0, 0.05)]
    return spark.createDataFrame(rows, "row_id long, gt int, prob double")


def test_half_is_positive_and_cohorts(ten):
    got = {r.row_id: r.error_type for r in C.classified(ten).collect()}
    assert got == {1: "TP", 2: "TP", 3: "FP", 4: "TP", 5: "FP", 6: "FN", 7: "TN", 8: "TN", 9: "FN", 10: "TN"}
    hard = C.classified(ten.withColumn("y", F.when(F.col("row_id") == 1, 0)), hard="y")
    assert hard.where("row_id = 1").first().error_type == "FN"


def test_confusion_and_zero_denominators(spark, ten):
    r = M.classification(C.classified(ten)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 2, 2, 3) and r.accuracy == 0.6 and r.fpr == 0.4
    empty = M.classification(C.classified(ten).where("false")).first()
    assert (empty.tn, empty.precision, empty.accuracy) == (0, 0.0, 0.0)


def test_roc_auc_matches_rank_formula(ten):
    rows = [(r.gt, r.prob) for r in ten.collect()]
    points = M.roc_points(ten, drop=False)
    assert [(r.fp, r.tp) for r in points.orderBy("place").collect()] == roc_by_hand(rows)
    pairs = [(a, b) for y, a in rows if y for z, b in rows if not z]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert math.isclose(M.auc(points).first().auc, auc)
    assert math.isclose(M.auc(M.roc_points(ten)).first().auc, auc)


def test_tpr_at_fpr(ten):
    points = M.roc_points(ten)
    assert M.tpr_nearest(points, 0.2).first().fpr == 0.0  # (0.2, 0.4) is collinear and dropped; ties go to the first point
    assert M.tpr_nearest(M.roc_points(ten, drop=False), 0.2).first().fpr == 0.2
    inter = M.tpr_interpolated(points, 0.3).first().tpr
    assert math.isclose(inter, 0.4 + (0.6 - 0.4) * 0.5)
    assert M.tpr_interpolated(points, 1.0).first().tpr == 1.0


def test_published_counts_give_published_rates(spark):
    """A published run: 350, 116, 65 and 1969 of 2500."""
    df = spark.range(2500).selectExpr("cast(id >= 466 as int) as gt", "cast(case when id < 350 then 0 when id < 466 then 1 when id < 531 then 0 else 1 end as int) as pred")
    r = M.classification(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (350, 116, 65, 1969)
    assert abs(r.accuracy - 0.9276) < 1e-9 and abs(r.precision - 0.94436) < 1e-5 and abs(r.recall - 0.96804) < 1e-5 and abs(r.fpr - 0.24893) < 1e-5


def test_typical_cases_and_ties(ten):
    c = C.classified(ten)
    hard = [(r.error_type, r.row_id) for r in C.typical(c, 1, easy=False).collect()]
    assert sorted(hard) == [("FN", 9), ("FP", 3)]
    easy = [(r.error_type, r.row_id) for r in C.typical(c, 1, easy=True).collect()]
    assert sorted(easy) == [("TN", 7), ("TP", 4)]


def test_variance_skips_nan_and_null(spark):
    df = spark.createDataFrame([("FN", 1.0, None), ("FN", 3.0, float("nan")), ("FN", None, 5.0)], "error_type string, a double, b double")
    got = {r.feature: (r.mean, r.var) for r in C.top_variance(df, ["a", "b"], 2).collect()}
    assert got == {"a": (2.0, 1.0), "b": (5.0, 0.0)}


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(60.0,), (60.0,)], "x double")
    assert [r.s for r in df.select(N.scaled(F.col("x"), F.lit(60.0), F.lit(60.0)).alias("s")).collect()] == [0.0, 0.0]
    model = LinearModel((("x", 60.0, 60.0, 2.0),), 1.0)
    assert model.scored(df).first().decision == 1.0
    with pytest.raises(ValueError):
        model.scored(df.withColumnRenamed("x", "y"))


def test_sigmoid_is_clipped(spark):
    r = spark.range(1).select(N.sigmoid(F.lit(-1e6)).alias("a"), N.sigmoid(F.lit(1e6)).alias("b")).first()
    assert 0 < r.a < 1e-200 and r.b == 1.0


def test_rules_compile_and_defaults(spark):
    df = spark.createDataFrame([(0.4, 20.0, 0.0), (0.6, 3.0, 2.0), (0.5, None, 1.0)], "prob double, n double, z double")
    value = lambda code: [r.v for r in df.select(R.compiled(code, df.columns).alias("v")).collect()]
    head = "def apply_rule_patch(svm_prob, features):\n"
    assert value(head + "    return -1") == [-1, -1, -1]
    assert value(head + "    if features.get('fill_ratio', 1.0) > 0.93 and features.get('n', 0) > 15:\n        return 0\n    return -1") == [0, -1, -1]
    assert value(head + "    if features.get('fill_ratio', 0) > 0.93:\n        return 0\n    return -1") == [-1, -1, -1]
    assert value(head + "    x = 1 / features.get('z', 0)\n    if x < 0.75:\n        return 1\n    elif svm_prob == 0.5:\n        return 0\n    return -1") == [-1, 1, 0]
    assert value(head + "    if 0.45 <= svm_prob < 0.55 or not svm_prob < 0.9:\n        return 1\n    return 7") == [-1, -1, 1]
    for bad in ("import os", head + "    return __import__('os').system('x')", head + "    for i in range(3):\n        pass", "def f(:"):
        with pytest.raises(R.RuleError):
            R.compiled(bad, df.columns)


def test_rule_fitness_counts(ten):
    c = C.classified(ten)
    p = F.col("prob")
    got = {r.rule: r for r in R.fitness(c, {"up": F.when(p < 0.5, 1).otherwise(-1), "down": F.when(p >= 0.5, 0).otherwise(-1), "broken": None}).collect()}
    up, down, broken = got["up"], got["down"], got["broken"]
    assert (up.fn_corr, up.fn_miss, up.fp_corr, up.fp_over, up.easy_overrides) == (2, 0, 0, 2, 3)
    assert (down.fn_corr, down.fn_miss, down.fp_corr, down.fp_over, down.easy_overrides) == (0, 2, 2, 0, 3)
    assert broken.score == 0.0 and math.isclose(up.score, up.raw_score * (1 - 0.1 * 3 / 6))
    ranked = {r.rule: r.rank for r in R.ranked(R.fitness(c, {"down": F.when(p >= 0.5, 0).otherwise(-1), "up": F.when(p < 0.5, 1).otherwise(-1)})).collect()}
    assert ranked == {"down": 1, "up": 2}


def test_rules_apply_in_order(ten):
    c = C.classified(ten)
    h = R.applied(c, [F.when(F.col("row_id") == 6, 1).otherwise(-1), F.when(F.col("row_id").isin(6, 3), 0).otherwise(-1)])
    got = {r.row_id: (r.hybrid, r.p) for r in h.withColumn("p", R.synthetic_probability()).collect()}
    assert got[6] == (1, 0.95) and got[3] == (0, 0.05) and got[1] == (1, 0.9)


def test_first_row_mask(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 3, False)], "k long, r long, bad boolean")
    assert [r.r for r in R.first_row_mask(df, "k", "r", F.col("bad")).where("hard").collect()] == [1]


def test_roc_over_many_distinct_scores(spark):
    """Distinct scores that rounding would merge, dealt over several ranges; the area is that of ranks, the last scores null."""
    rows = [(i * 37 % 2, 0.5 + (i * 7919 % 500) * 1e-9) for i in range(1000)] + [(1, None)]
    points = M.roc_points(spark.createDataFrame(rows, "gt int, prob double"), drop=False)
    got = [(r.place, r.fp, r.tp) for r in points.orderBy("place").collect()]
    want, fp, tp = [(1, 0, 0)], 0, 0
    for s in [*sorted({s for _, s in rows[:-1]}, reverse=True), None]:
        fp, tp = fp + sum(g == 0 and x == s for g, x in rows), tp + sum(g == 1 and x == s for g, x in rows)
        want.append((len(want) + 1, fp, tp))
    assert got == want
    none = M.roc_points(spark.createDataFrame([], "gt int, prob double"))
    assert [(r.place, r.fp, r.tp) for r in none.collect()] == [(1, 0, 0)] and M.auc(none).first().auc == 0


def test_curve_metrics_of_groups_equal_plain_ones(spark):
    """Ties, a group with one class only, null scores; each group as if it were alone."""
    import random

    rng = random.Random(4)
    rows = [(g, int(rng.random() < s), s) for g in ("a", "b", None) for s in [round(rng.random(), 1 if g == "a" else 2) for _ in range(120)]]
    rows += [("b", 1, None), ("c", 1, 0.5), ("c", 1, 0.25)]
    df = spark.createDataFrame(rows, "trial string, gt int, prob double")
    got = {r.trial: r for r in M.curve_metrics(M.score_steps(df, "trial"), "trial", at=0.1).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        own = df.where(F.col("trial").eqNullSafe(F.lit(g)))
        points = M.roc_points(own)
        near, inter = M.tpr_nearest(points, 0.1).first(), M.tpr_interpolated(points, 0.1).first()
        assert math.isclose(r.auc, M.auc(points).first().auc) and r.nearest.asDict() == near.asDict() and math.isclose(r.tpr_interp, inter.tpr)
        mine = [(y, s) for t, y, s in rows if t == g]
        assert math.isclose(r.accuracy, sum((s is not None and s >= 0.5) == (y == 1) for y, s in mine) / len(mine))
    assert M.curve_metrics(M.score_steps(df.where("false"), "trial"), "trial").count() == 0


def test_curve_plan_reads_the_scores_alone(spark, ten):
    plan = M.curve_metrics(M.score_steps(ten))._jdf.queryExecution().optimizedPlan().toString()
    assert "scores" in plan or "parquet" in plan
    assert "row_id" not in plan  # the input was read once, before


def test_exact_sigmoid_is_right_to_the_last_bit(spark):
    import math

    from palletry.functions.numeric import sigmoid

    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(size=20000) * 3] + [None, 1e9, -1e9, float("nan")]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", sigmoid(F.col("x"), exact=True).alias("p"), sigmoid(F.col("x")).alias("q")).collect()
    for r in got[:20000]:
        assert r.p == 1 / (1 + math.exp(-r.x)) and abs(r.p - r.q) < 1e-15
    assert all(r.p == pytest.approx(r.q, rel=1e-12) for r in got[20000:])  # a null counts as the upper bound in both
