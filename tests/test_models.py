"""Linear fits, stacks, searches, kernels, forests as tables and versions, against numpy and by hand."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from palletry.operators import forest, grove, ml, newton as N
from palletry.sources import snapshots

SCHEMA = "id long, y double, fold int, x array<double>"


def rows(n=240, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d))
    y = (x @ np.arange(1, d + 1) + rng.normal(size=n) * 0.6 > (d + 1) * d / 4).astype(float)
    return x, y, np.arange(n) % 4


def frame(spark, x, y, fold):
    return spark.createDataFrame([(i, float(b), int(f), [float(c) for c in a]) for i, (a, b, f) in enumerate(zip(x, y, fold))], SCHEMA).repartition(3).cache()


def logistic(x, y, c):
    """Plain Newton steps for |w|**2 / 2 + c * sum of losses."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    free = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(np.diag(free) + c * (z.T * (p * (1 - p))) @ z, free * w + c * z.T @ (p - y))
    return w


def test_all_folds_and_weights_are_fitted_together(spark):
    x, y, fold = rows()
    models = [N.Linear("a", "logistic", 4.0), N.Linear("b", "logistic", 0.3, (0, 2), 1), N.Linear("b", "logistic", 0.3, (0, 2), 2), N.Linear("c", "hinge", 2.0)]
    w = N.fitted(frame(spark, x, y, fold), models, label="y", fold="fold")
    assert np.allclose(w[0], logistic(x, y, 4.0), atol=1e-6)
    for m, got in zip(models[1:3], w[1:]):
        own = fold != m.without
        assert np.allclose(got, logistic(x[own][:, [0, 2]], y[own], 0.3), atol=1e-6)
    z = np.c_[x, np.ones(len(x))]
    total = lambda v: v[:-1] @ v[:-1] / 2 + 2.0 * N._loss("hinge", z @ v, y)[0].sum()
    assert all(total(w[3] + e) >= total(w[3]) - 1e-9 for e in 1e-3 * np.random.default_rng(1).normal(size=(200, 4)))
    assert np.mean((z @ w[3] > 0) == (y > 0)) > 0.85


def test_models_that_differ_in_c_share_their_way_and_equal_rows_weigh(spark, monkeypatch):
    x, y, fold = rows(120)
    copies = 1 + np.arange(120) % 3
    cs = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]
    models = [N.Linear(f"{kind}{c}", kind, c, None, f) for kind in ("logistic", "hinge") for f in (1, 2) for c in cs]
    each = [np.repeat(a, copies, axis=0) for a in (x, y, fold)]
    whole = N.fitted(frame(spark, *each), models, label="y", fold="fold")
    passes, sums = [], N._sums
    monkeypatch.setattr(N, "START", 60)
    monkeypatch.setattr(N, "_sums", lambda own, *rest: (passes.append(len(own)), sums(own, *rest))[1])
    df = frame(spark, x, y, fold).join(spark.createDataFrame([(i, int(n)) for i, n in enumerate(copies)], "id long, n long"), "id")
    w = N.fitted(df, models, label="y", fold="fold", n="n")
    for m, a, b in zip(models, w, whole):
        assert np.allclose(a, b, atol=1e-5)
        own = each[2] != m.without
        assert m.loss == "hinge" or np.allclose(a, logistic(each[0][own], each[1][own], m.c), atol=1e-6)
    assert passes[0] == 4  # one a loss and fold goes first
    monkeypatch.undo()


def test_calibration_equals_numpy(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=300) * 2
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.7 * d - 0.4)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(d, y)] + [(None, 1), (0.5, None)], "decision double, gt int")
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w, z = np.array([0.0, 0.0]), np.c_[d, np.ones(300)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z.T * (p * (1 - p))) @ z, z.T @ (p - t))
    assert np.allclose(N.calibrated(df, "decision", "gt"), w, atol=1e-8)
    assert N.calibrated(df.where("false"), "decision", "gt") == (0.0, 0.0)
    apart = N.calibrated(spark.createDataFrame([(-2.0, 0), (-1.0, 0), (1.0, 1), (3.0, 1)], "decision double, gt int"), "decision", "gt")
    assert all(map(math.isfinite, apart)) and apart[0] > 0


@pytest.fixture(scope="module")
def memorable(spark):
    """Labels that features say nothing about: only a model that has seen a row can know its label."""
    rng = np.random.default_rng(5)
    data = [(i, int(rng.random() < 0.5), float(rng.random()), float(rng.random()), i >= 320) for i in range(400)]
    return data, spark.createDataFrame(data, "id long, gt int, a double, b double, is_test boolean").cache()


def test_no_base_score_has_seen_its_label(spark, memorable):
    data, df = memorable
    bases = [ml.Base("lr", "lr", 3.0), ml.Base("rf", "rf", 1.0, (15, 12, 1))]
    oof = ml.out_of_fold(df, ["a", "b"], "id", "gt", bases, 3, "is_test").collect()
    assert len(oof) == 400 and {r.id for r in oof if r.fold < 0} == set(range(320, 400)) and {r.fold for r in oof} == {-1, 0, 1, 2}
    hit = np.mean([(r.rf > 0.5) == (r.label > 0.5) for r in oof])
    assert 0.35 < hit < 0.65  # a forest that saw the row would be near 1
    x = np.array([[r[2], r[3]] for r in data])
    lo, hi = x[:320].min(0), x[:320].max(0)
    x, y = (x - lo) / (hi - lo), np.array([float(r[1]) for r in data])
    fold = np.array([r.fold for r in sorted(oof, key=lambda r: r.id)])
    for f in (0, 2, -1):
        w = logistic(x[(fold >= 0) & (fold != f)], y[(fold >= 0) & (fold != f)], 3.0)
        for r in oof:
            if r.fold == f:
                assert abs(r.lr - 1 / (1 + math.exp(-(x[r.id] @ w[:-1] + w[-1])))) < 1e-6


def test_stack_and_its_defaults(spark, memorable):
    assert [b.kind for b in map(ml.Base.surveyed, ("svm", "lr", "rf", "gbdt"))] == ["svm", "lr", "rf", "gbdt"]
    assert ml.Base.surveyed("rf").sizes == (200, 20, 2) and ml.Base.surveyed("gbdt").sizes == (400, 6, 0.1)
    bases = [ml.Base("svm", "svm", 1.0), ml.Base("gbdt", "gbdt", 1.0, (3, 2, 0.1))]
    for meta in ("logreg", "mlp"):
        out = ml.stacked(memorable[1], ["a", "b"], "id", "gt", bases, 2, meta).collect()
        assert len(out) == 400 and all(0 <= r.prob <= 1 and 0 <= r.svm <= 1 and 0 <= r.gbdt <= 1 for r in out)


def test_search_picks_the_best_by_tuple(spark):
    x, y, fold = rows(200, 2, 9)
    df = spark.createDataFrame([(i, int(b), float(a[0]), float(a[1]), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))], "id long, gt int, a double, b double, is_test boolean")
    out = ml.ensemble_search(df, ["a", "b"], "id", "gt", "is_test", n=3, k=2, others=[]).collect()
    best = [r for r in out if r.best]
    assert len(out) == 3 and len(best) == 1 and (best[0].auc, best[0].tpr1, best[0].accuracy) == max((r.auc, r.tpr1, r.accuracy) for r in out)
    assert best[0].auc > 0.7 and all(10**-1.3 <= r.meta_c <= 10**1.5 for r in out)
    assert ml.drawn_trials(3) == ml.drawn_trials(3) and ml.drawn_trials(5)[:3] == ml.drawn_trials(3)


def test_search_takes_equal_rows_as_one(spark, monkeypatch):
    x, y, _ = rows(60, 2, 9)
    rng = np.random.default_rng(1)
    data = [(i, int(y[i % 60]), *map(float, x[i % 60]), bool(rng.random() < 0.25)) for i in range(1200)]
    df = spark.createDataFrame(data, "id long, gt int, a double, b double, is_test boolean")
    seen, fitted = [], ml.fitted
    monkeypatch.setattr(ml, "fitted", lambda d, *rest, **kw: (seen.append(d.count()), fitted(d, *rest, **kw))[1])
    got = ml.ensemble_search(df, ["a", "b"], "id", "gt", "is_test", n=2, k=2, others=[]).orderBy("trial").collect()
    assert len(seen) == 2 and max(seen) <= 60 * 2
    trials = ml.drawn_trials(2)
    bases = [b for t in trials for b in (ml.Base(f"svm{t['trial']}", "svm", t["svm_c"]), ml.Base(f"lr{t['trial']}", "lr", t["lr_c"]))]
    oof = ml.out_of_fold(df, ["a", "b"], "id", "gt", bases, 2, "is_test")  # row by row
    want = ml.trial_report(ml.trial_scores(oof, "id", trials, [["svm1", "lr1"], ["svm2", "lr2"]])).orderBy("trial").collect()
    assert all(np.allclose([a[c] for c in ("auc", "tpr1", "accuracy")], [b[c] for c in ("auc", "tpr1", "accuracy")], atol=1e-9) for a, b in zip(got, want, strict=True))


def test_meta_models_of_trials_equal_single_fits(spark):
    x, y, fold = rows(160, 3, 2)
    fold = np.where(np.arange(160) % 5 == 0, -1, fold)
    oof = spark.createDataFrame([(i, float(b), int(f), *map(float, a)) for i, (a, b, f) in enumerate(zip(x, y, fold))], "id long, label double, fold int, p double, q double, r double")
    trials = [{"trial": 1, "meta_c": 5.0}, {"trial": 2, "meta_c": 0.1}]
    got = ml.trial_scores(oof, "id", trials, [["p", "q"], ["r", "p"]]).collect()
    assert len(got) == 2 * 32
    for t, c, own in ((1, 5.0, [0, 1]), (2, 0.1, [2, 0])):
        w = logistic(x[fold >= 0][:, own], y[fold >= 0], c)
        assert all(abs(r.prob - 1 / (1 + math.exp(-(x[r.id][own] @ w[:-1] + w[-1])))) < 1e-6 for r in got if r.trial == t)


def test_fourier_features_approach_the_kernel_and_its_machine(spark):
    """Rings, which no line parts; an exact kernel machine (the same rounded hinge, solved in the span of all rows) is the measure."""
    rng = np.random.default_rng(4)
    angle, radius = rng.random(300) * 2 * np.pi, np.where(np.arange(300) % 2, 1.0, 2.0) + rng.normal(size=300) * 0.25
    x, y = np.c_[radius * np.cos(angle), radius * np.sin(angle)], (np.arange(300) % 2).astype(float)
    test = np.arange(300) % 4 >= 2
    df = spark.createDataFrame([(i, int(b), float(a[0]), float(a[1]), bool(t)) for i, (a, b, t) in enumerate(zip(x, y, test))], "id long, gt int, a double, b double, t boolean")
    got = {r.id: r.prob for r in ml.rbf_svm(df, ["a", "b"], "id", "gt", "t", n=150).collect()}
    u = (x - x[~test].min(0)) / (x[~test].max(0) - x[~test].min(0))
    gamma = 1 / (2 * u[~test].var())
    k = np.exp(-gamma * ((u[:, None] - u[~test][None]) ** 2).sum(2))
    own, t, a = k[~test], y[~test], np.zeros(151)
    z = np.c_[own, np.ones(150)]
    free = np.zeros((151, 151))
    free[:150, :150] = own
    objective = lambda v: v @ free @ v / 2 + 10 * N._loss("hinge", z @ v, t)[0].sum()
    for _ in range(100):
        _, slope, bend = N._loss("hinge", z @ a, t)
        step = np.linalg.lstsq(free + 10 * (z.T * bend) @ z + 1e-9 * np.eye(151), free @ a + 10 * z.T @ slope, rcond=None)[0]
        size = 1.0
        while objective(a - size * step) > objective(a) and size > 1e-6:
            size /= 2
        a = a - size * step
    exact = (k @ a[:-1] + a[-1] > 0) == (y > 0)
    close = np.array([(got[i] > 0.5) == (y[i] > 0) for i in range(300)])
    assert exact[test].mean() > 0.9 and abs(close[test].mean() - exact[test].mean()) < 0.03
    vectors = [[0.1, 0.2], [0.4, 0.1]]
    f = spark.createDataFrame([(v,) for v in vectors], "x array<double>").select(ml.random_features(F.col("x"), 2, 4000, F.lit(3.0)).alias("f")).collect()
    assert abs(np.dot(f[0].f, f[1].f) - math.exp(-3 * 0.1)) < 0.05


def test_logreg_sees_no_test_row(spark):
    x, y, _ = rows(120, 2, 6)
    for flip in (False, True):
        df = spark.createDataFrame([(i, int(b) if i % 3 or not flip else 1 - int(b), float(a[0]), float(a[1]), i % 3 == 0) for i, (a, b) in enumerate(zip(x, y))], "id long, gt int, a double, b double, t boolean")
        got = {r.id: r.prob for r in ml.logreg_scores(df, ["a", "b"], "id", "gt", "t").collect()}
        same = got if not flip else same
        assert all(abs(got[i] - same[i]) < 1e-9 for i in got)
        if not flip:
            same = got


NODES = "tree int, node int, left int, right int, feature int, threshold double, impurity double"


def test_leaves_depth_and_lookup_by_hand(spark):
    n = [(0, 0, 1, 2, 0, 0.5, 0.5), (0, 1, None, None, None, None, 0.1), (0, 2, 3, 4, 1, 0.3, 0.4), (0, 3, None, None, None, None, 0.2), (0, 4, None, None, None, None, 0.3), (1, 0, None, None, None, None, 0.45)]
    nodes = forest.with_depth(spark.createDataFrame(n, NODES))
    assert {(r.tree, r.node): (r.depth, r.max_depth) for r in nodes.collect()} == {(0, 0): (0, 2), (0, 1): (1, 2), (0, 2): (1, 2), (0, 3): (2, 2), (0, 4): (2, 2), (1, 0): (0, 0)}
    data = [(1, 1.0, [0.5, 0.9]), (2, 0.0, [0.1, 0.0]), (3, 1.0, [0.6, 0.3]), (4, 0.0, [None, 0.4])]
    reached = forest.leaves(spark.createDataFrame(data, "id long, label double, x array<double>"), nodes, "id", "x", "label")
    assert {(r.id, r.tree): r.node for r in reached.collect()} == {(1, 0): 1, (2, 0): 1, (3, 0): 3, (4, 0): 4, (1, 1): 0, (2, 1): 0, (3, 1): 0, (4, 1): 0}
    words = forest.vocabulary(reached.where("id <= 3"), nodes)
    got = {r.token: (r.tree, r.node, r.pos_rate, r.log_count, r.depth_norm, r.impurity) for r in words.collect()}
    share = 2 / 3
    assert {k: v[:2] for k, v in got.items()} == {0: (0, None), 1: (0, 1), 2: (0, 3), 3: (1, None), 4: (1, 0)}
    assert np.allclose([got[k][2:] for k in range(5)], [(share, 0, 0, 0), (0.5, math.log(3), 0.5, 0.1), (1 - 1e-4, math.log(2), 1, 0.2), (share, 0, 0, 0), (share, math.log(4), 0, 0.45)])
    new = {(r.id, r.tree): (r.token, r.log_count) for r in forest.looked_up(forest.tokens(reached, words), words).collect()}
    assert new[4, 0] == (0, 0.0) and new[4, 1] == (4, math.log(4)) and new[3, 0] == (2, math.log(2))


def test_walked_leaves_are_the_model_s(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x, y, fold = rows(200, 3, 7)
    df = frame(spark, x, y, fold).withColumn("features", array_to_vector("x"))
    model = RandomForestClassifier(numTrees=4, maxDepth=5, seed=1, labelCol="y", leafCol="leaf").fit(df)
    nodes = forest.with_depth(forest.node_table(model, spark))
    mine = forest.leaves(df, nodes, "id").collect()
    theirs = {(r.id, t): leaf for r in model.transform(df).select("id", vector_to_array("leaf").alias("leaf")).collect() for t, leaf in enumerate(r.leaf)}
    pairs = {(r.tree, r.node, theirs[r.id, r.tree]) for r in mine}
    assert len(mine) == 800 and len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})


def test_a_writer_that_dies_leaves_the_last_complete_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        snapshots.read_version(spark, root)
    assert snapshots.write_version(spark.range(3), root, note="first") == 1

    class Dies(type(spark.range(1).write)):
        def json(self, *a, **k):
            raise RuntimeError("lost")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.json", Dies.json)
    with pytest.raises(RuntimeError):
        snapshots.write_version(spark.range(99), root)
    monkeypatch.undo()
    assert snapshots.read_version(spark, root).count() == 3
    assert snapshots.write_version(spark.range(5).selectExpr("id", "'x' as s"), root, keep=1) == 2
    assert snapshots.read_version(spark, root).columns == ["id", "s"] and snapshots.versions(spark, root).count() == 2
    with pytest.raises(Exception):
        snapshots.read_version(spark, root, 1).count()


def many_rows(spark, n=4000):
    return spark.range(n).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 3 as double) as b", "cast(id % 7 + id % 3 > 4 as int) as gt")


def test_trees_of_a_stack_grow_on_cells(spark, monkeypatch):
    seen, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data: (seen.append(data.agg(F.count("*"), F.sum("weight") if "weight" in data.columns else F.count("*")).first()), fit(self, data))[1])
    out = ml.out_of_fold(many_rows(spark), ["a", "b"], "id", "gt", [ml.Base("rf", "rf", sizes=(5, 4, 2))], k=4)
    rows = out.collect()
    assert len(rows) == 4000 and all(r.rf == pytest.approx(r.label, abs=0.3) for r in rows)
    assert all(count <= 21 * 3 * ml.PARTS and abs(weight - 3000) < 3 for count, weight in seen) and len(seen) == 4


def test_bins_keep_few_values_apart_and_order_many(spark):
    df = spark.range(1000).selectExpr("id", "array(id % 4 * 10.0D, sqrt(id), 1.0D) as x").union(spark.sql("select 1000L, array(100.0D, double('NaN'), 1.0D)"))
    got = {r.id: (r.x, r.bins) for r in ml.binned(df, df.where("id < 1000"), 3).collect()}
    assert {(x[0], b[0]) for x, b in got.values()} == {(0, 0), (10, 1), (20, 2), (30, 3), (100, 3)}
    order = [got[i][1][1] for i in range(1000)]
    assert order == sorted(order) and 30 <= len(set(order)) <= 32 and got[1000][1][1] > order[-1]
    assert {b[2] for _, b in got.values()} == {0}


def test_a_start_on_some_rows_saves_passes_and_changes_nothing(spark, monkeypatch):
    x, y, fold = rows(3000)
    df, passes = frame(spark, x, y, fold), []
    models = [N.Linear("a", "logistic", 4.0), N.Linear("b", "logistic", 0.3, (0, 2), 1), N.Linear("c", "hinge", 2.0)]
    before = N.fitted(df, models, label="y", fold="fold")
    take = N._Steps.take
    monkeypatch.setattr(N._Steps, "take", lambda self, *a: (passes.append(self.model.c in (4.0, 0.3, 2.0)), take(self, *a))[1])
    N.fitted(df, models, label="y", fold="fold")
    cold = sum(passes)
    monkeypatch.setattr(N, "START", 1000)
    passes.clear()
    for a, b in zip(before, N.fitted(df, models, label="y", fold="fold")):
        assert np.allclose(a, b, atol=1e-7)
    assert 0 < sum(passes) < 0.7 * cold and len(passes) > sum(passes)


def test_features_made_in_the_task_equal_the_columns(spark):
    x, _, _ = rows(50)
    column = ml.random_features(F.col("x"), 3, 8, F.lit(0.7))
    got = [r.f for r in frame(spark, x, np.zeros(50), np.zeros(50)).orderBy("id").select(column.alias("f")).collect()]
    assert np.allclose(got, ml.fourier(3, 8, 0.7)(x), atol=1e-12)


def test_leaves_are_those_of_joins(spark, monkeypatch):
    """One walk in a task, without joins, whatever the depth; nulls, NaN, short vectors, leaves as roots and absent trees."""
    rng = np.random.default_rng(8)
    n = [(t, k, *((2 * k + 1, 2 * k + 2, int(rng.integers(3)), float(rng.integers(-2, 3))) if k < 7 and (t, k) not in ((0, 4), (1, 0)) else (None,) * 4), 0.5) for t in (0, 1, 3) for k in range(15) if t != 1 or not k]
    nodes = forest.with_depth(spark.createDataFrame([r for r in n if r[:2] not in ((0, 9), (0, 10))], "tree int, node int, left int, right int, feature int, threshold double, impurity double"))
    x = [None, [], [1.0], [math.nan, None, 2.0], *[[float(v) for v in rng.integers(-3, 4, 3)] for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(x)), "id long, x array<double>")
    got = forest.leaves(df, nodes, "id")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(forest, "WALKED_NODES", -1)
    want = forest.leaves(df, nodes, "id")
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4 * len(x)


def test_trees_grown_together_split_best_and_score_what_they_did_not_see(spark):
    """One boosted step by hand on places of two folds; then forests and boosted trees beside Spark ML's on the same places."""
    w, t = np.array([[[4.0, 2, 0, 2], [1, 3, 3, 1]]]), np.array([[[0.0, 1, 0, 2], [1, 1, 0, 1]]])
    feature, last, values = grove._best(w, t, 1.0)
    assert (feature[0], last[0]) == (0, 0) and np.allclose(values, [[0, 3 / 4]])
    assert grove._best(w, w / 2, 1.0)[0][0] == -1 and grove._best(w, t, 5.0)[0][0] == -1
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 8, (3000, 3))
    y = rng.random(3000) < 1 / (1 + np.exp(-(bins[:, 0] - 3.5) * (bins[:, 1] - 3.5) / 2))
    data = [([float(v) for v in b], float(v), i % 3 - (i % 3 == 2) * 3, 2) for i, (b, v) in enumerate(zip(bins, y))]
    df = spark.createDataFrame(data, "bins array<double>, label double, fold int, n long")
    trained = grove.Trained(df, 3, 2, 8, 3)
    groves = [g for f in (0, 1, None) for g in (grove.Grove("rf", 20, 6, 2, None, f), grove.Grove("gb", 12, 3, step=0.3, without=f), grove.Grove("one", 1, 1, step=1.0, without=f))]
    out = df.join(trained.scores(groves), ["bins", "fold"]).collect()
    assert len(out) == 3000 and {r.fold for r in out} == {0, 1, -1}

    def brier(name, rows):
        return np.mean([(r[name] - r.label) ** 2 for r in rows])

    truth = np.mean([(1 / (1 + math.exp(-(r.bins[0] - 3.5) * (r.bins[1] - 3.5) / 2)) - r.label) ** 2 for r in out])
    assert all(brier(name, out) < truth + 0.04 for name in ("rf", "gb"))
    seen = [(b, v) for b, v, f, _ in data if f == 1]  # fold 0 is scored by these
    mean = np.mean([v for _, v in seen])
    sides = {(f, at): [np.mean([v for b, v in seen if (b[f] <= at) is left]) - mean for left in (True, False)] for f in range(3) for at in range(7)}
    best = max(sides, key=lambda s: sum(sides[s][i] ** 2 * sum((b[s[0]] <= s[1]) is left for b, _ in seen) for i, left in enumerate((True, False))))
    margin = lambda b: math.log(mean / (1 - mean)) + sides[best][0 if b[best[0]] <= best[1] else 1] / (mean * (1 - mean))
    assert all(abs(r.one - 1 / (1 + math.exp(-margin(r.bins)))) < 1e-5 for r in out if r.fold == 0)
    flipped = grove.Trained(df.withColumn("label", F.when(F.col("fold") == 0, 1 - F.col("label")).otherwise(F.col("label"))), 3, 2, 8, 3).scores(groves)
    both = flipped.where("fold = 0").join(trained.scores(groves).where("fold = 0").selectExpr("bins", "rf as a", "gb as b"), "bins").collect()
    assert both and all(abs(r.rf - r.a) < 1e-6 and abs(r.gb - r.b) < 1e-6 for r in both)  # no row's label reaches its score


def test_each_trial_draws_trees_of_its_own(spark, monkeypatch):
    x, y, _ = rows(200, 2, 9)
    df = spark.createDataFrame([(i, int(b), float(a[0]), float(a[1]), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))], "id long, gt int, a double, b double, is_test boolean")
    sizes = {"rf_trees": (2, 4), "rf_depth": (None, 3), "rf_least": (1, 2), "gbdt_rounds": (2, 10), "gbdt_depth": (2, 3), "gbdt_step": (0.1, 0.3)}
    seen, columns = [], ml.trial_scores
    monkeypatch.setattr(ml, "trial_scores", lambda oof, n, trials, own, *rest: (seen.extend(own), columns(oof, n, trials, own, *rest))[1])
    out = ml.ensemble_search(df, ["a", "b"], "id", "gt", "is_test", n=3, k=2, sizes=sizes).orderBy("trial").collect()
    assert seen == [[f"{kind}{i}" for kind in ("svm", "lr", "rf", "gbdt")] for i in (1, 2, 3)]
    assert [{k: r[k] for k in sizes} for r in out] == [{k: t[k] for k in sizes} for t in ml.drawn_trials(3, trees=sizes)]
    assert [t["svm_c"] for t in ml.drawn_trials(3)] == [r.svm_c for r in out] and all(r.auc > 0.7 for r in out)
    assert len({tuple(t.values()) for t in ml.drawn_trials(12, trees=ml.TRIAL_TREES)}) == 12 and ml.TRIAL_TREES["gbdt_rounds"] == (250, 400, 600, 800)
