"""Classifiers over feature columns with Spark ML: single models, stacking and leaf tokens.

Trees tell at most `BINS` ranges of a feature apart, as Spark ML's do, so they grow on cells: rows that agree in all ranges and in the label
are counted once and weigh by their number. What trees cost thus depends on the cells that occur, not on the rows. Stacks and the
search over them grow the trees of all folds and trials together (`grove`).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import scaled, sigmoid
from palletry.operators.grove import Grove, Trained
from palletry.operators.metrics import curve_metrics, score_steps
from palletry.operators.newton import Linear, fitted, scored
from palletry.operators.splits import stratified_folds
from palletry.sources.snapshots import stored


#: Surveyed sizes: trees, depth and least rows of a leaf of the forest; rounds, depth and step of the boosted trees.
FOREST, BOOSTED = (200, 20, 2), (400, 6, 0.1)
#: Surveyed losses' weights.
C = {"svm": 1.9124740037393821, "lr": 4.736286181285866, "logreg": 1.5688869685092588}


#: Ranges of a feature that trees tell apart, and into how many instances a cell of many rows goes.
BINS, PARTS = 32, 2


def binned(df: DataFrame, of: DataFrame, width: int, x: str = "x", keep: list[str] | None = None) -> DataFrame:
    """`keep` (or all columns) of `df` and `bins`, the numbers of the ranges that the entries of `x`, vectors of `width` numbers, lie in.

    The ranges are bounded by quantiles of `of`, a stored table, or lie halfway between its values where it has few. NaN is in the last one.
    """
    names = [f"_x{i}" for i in range(width)]
    entries = lambda d: d.select("*", *[F.get(x, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    seen = entries(of).select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    counts = seen.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    few, many = ([n for n in names if (counts[n] <= BINS) is small] for small in (True, False))
    values = seen.agg(*[F.collect_set(n).alias(n) for n in few]).first().asDict() if few else {}  # some `BINS` values each
    ends = {n: [(a + b) / 2 for a, b in zip(sorted(v), sorted(v)[1:])] for n, v in values.items()}
    if many:
        ends |= zip(many, seen.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.1 / BINS))
    wanted, inf = [n for n in names if ends[n]], float("inf")
    out = entries(df)
    if wanted:
        splits = [[-inf, *sorted(set(ends[n])), inf] for n in wanted]
        out = Bucketizer(splitsArray=splits, inputCols=wanted, outputCols=[f"_b{n}" for n in wanted], handleInvalid="keep").transform(out)
    bins = F.array(*[F.col(f"_b{n}") if n in wanted else F.lit(0.0) for n in names])
    return out.select(*(df.columns if keep is None else keep), bins.alias("bins"))


def cells(rows: DataFrame, *by: str) -> DataFrame:
    """(bins, by, n): how many of the binned rows agree, stored."""
    return stored(rows.groupBy("bins", *by).agg(F.count("*").alias("n")), "cells")


def grown_on(estimator, cells: DataFrame):
    """A tree model fitted on cells (bins, label, n). A cell goes into up to `PARTS` instances of equal weight, so bootstrapped trees
    draw parts of it and its rows can fill a leaf alone."""
    parts = F.least(F.col("n"), F.lit(PARTS)).cast("int")
    each = cells.select("bins", F.col("label").cast("double").alias("label"), "n", F.explode(F.array_repeat(F.col("n") / parts, parts)).alias("weight"))
    return estimator.setWeightCol("weight").setMaxBins(2 * BINS).fit(each.select("label", "weight", array_to_vector("bins").alias("features")))


@dataclass(frozen=True)
class Base:
    """A base model of a stack: its column, its kind (svm, lr, rf, gbdt) and its sizes."""

    name: str
    kind: str
    c: float = 1.0
    sizes: tuple = ()

    @classmethod
    def surveyed(cls, kind: str, sizes: tuple | None = None) -> Base:
        return cls(kind, kind, C.get(kind, 1.0), sizes or {"rf": FOREST, "gbdt": BOOSTED}.get(kind, ()))

    def linear(self, without: int | None) -> Linear:
        return Linear(self.name, {"lr": "logistic", "svm": "hinge"}[self.kind], self.c, None, without)

    def grove(self, without: int | None) -> Grove:
        n, depth, third = self.sizes
        return Grove(self.name, n, depth, third, None, without) if self.kind == "rf" else Grove(self.name, n, depth, step=third, without=without)

    def trees(self, seed: int = 42):
        common = {"labelCol": "label", "featuresCol": "features", "seed": seed}
        if self.kind == "rf":
            n, depth, least = self.sizes
            return RandomForestClassifier(numTrees=n, maxDepth=depth, minInstancesPerNode=least, maxMemoryInMB=1024, **common)
        if self.kind == "gbdt":
            n, depth, step = self.sizes
            return GBTClassifier(maxIter=n, maxDepth=depth, stepSize=step, **common)
        raise ValueError(self.kind)


def positive(predicted: DataFrame) -> Column:
    """P(label = 1); a margin alone goes through a sigmoid."""
    if "probability" in predicted.columns:
        return vector_to_array("probability")[1]
    return sigmoid(vector_to_array("rawPrediction")[1])


def predicted(model, df: DataFrame, name: str, *keep: str) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, positive(out).alias(name))


def with_folds(df: DataFrame, features: list[str], row: str, label: str, k: int = 5, test: str | None = None) -> DataFrame:
    """(row, label, x, fold), stored: scaled features and one of `k` folds, -1 where `test` is true. Features are scaled by the ranges of the other rows."""
    is_test = F.coalesce(F.col(test), F.lit(False)) if test else F.lit(False)
    rows = stored(df.select(row, F.col(label).cast("double").alias("label"), is_test.alias("_test"), *[F.col(f).cast("double").alias(f) for f in features]), "rows")
    ends = F.broadcast(rows.where("not _test").agg(*[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features]))  # one row
    x = F.array(*[F.coalesce(scaled(F.col(f), F.col(f"_lo_{f}"), F.col(f"_hi_{f}")), F.lit(0.0)) for f in features]).alias("x")
    data = rows.join(ends).select(row, "label", "_test", x)
    data = stratified_folds(data.where("not _test"), row, "label", k).unionByName(data.where("_test").withColumn("fold", F.lit(-1)))
    return stored(data.select(row, "label", "x", "fold"), "folds")


def out_of_fold(df: DataFrame, features: list[str], row: str, label: str, bases: list[Base], k: int = 5, test: str | None = None, parallel: int = 5) -> DataFrame:
    """(row, label, fold, a column a base model): each row scored by models that didn't see its fold, as a stored table.

    Rows of which `test` is true have fold -1 and are seen by no model; those fitted on all other rows score them. Features are
    scaled by the ranges of the rows that models see. Linear models of all folds share their passes (`newton`), trees
    of several folds grow at a time, on cells, and score each cell once. A row's label reaches only models that don't score it.
    """
    data = with_folds(df, features, row, label, k, test)
    return _base_scores(data, data, [row, "label", "fold"], len(features), bases, [*range(k), *([None] if test else [])], parallel=parallel)


def _base_scores(data: DataFrame, rows: DataFrame, keep: list[str], width: int, bases: list[Base], outside: list[int | None], n: str | None = None, parallel: int = 5, together: bool = False) -> DataFrame:
    """`keep` of `data` and a column a base model, stored. `rows` bound the trees' ranges; `n` names a column with the rows that a row of `data` stands for.

    Trees are those of Spark ML, a model at a time, or all models grow `together`.
    """
    models = [b.linear(f) for b in bases if b.kind in ("svm", "lr") for f in outside]
    weights = fitted(data.where("fold >= 0"), models, fold="fold", n=n) if models else []
    trees = [b for b in bases if b.kind not in ("svm", "lr")]
    if trees and together:
        data = stored(binned(data, rows.where("fold >= 0"), width), "bins")
        places = data.groupBy("bins", "label", "fold").agg((F.count("*") if n is None else F.sum(n)).alias("n"))
        folds = [f for f in outside if f is not None]
        trained = Trained(places, width, len(folds), BINS + 2, data.sparkSession.sparkContext.defaultParallelism)
        data = data.join(trained.scores([b.grove(f) for b in trees for f in outside]), ["bins", "fold"])
    elif trees:
        data = stored(binned(data, rows.where("fold >= 0"), width), "bins")
        seen_cells = stored(data.where("fold >= 0").groupBy("bins", "label", "fold").agg((F.count("*") if n is None else F.sum(n)).alias("n")), "cells")
        places = stored(data.select("bins", "fold").distinct(), "places").withColumn("features", array_to_vector("bins"))

        def grown(job: tuple[Base, int | None]) -> DataFrame:
            b, f = job
            train = seen_cells if f is None else seen_cells.where(F.col("fold") != f)
            return predicted(grown_on(b.trees(), train), places.where(F.col("fold") == (-1 if f is None else f)), b.name, "bins", "fold")

        jobs = [(b, f) for b in trees for f in outside]
        with ThreadPoolExecutor(parallel) as pool:
            found = list(pool.map(inheritable_thread_target(data.sparkSession)(grown), jobs))
        scores = [reduce(DataFrame.unionByName, [d for (own, _), d in zip(jobs, found) if own is b]) for b in trees]
        by_place = stored(reduce(lambda a, d: a.join(d, ["bins", "fold"]), scores), "scores")
        data = data.join(by_place, ["bins", "fold"])
    keep = [*keep, *[b.name for b in trees]]
    out = scored(data, models, weights, keep, fold="fold") if models else data
    return stored(out.select(*keep[: len(keep) - len(trees)], *[b.name for b in bases]), "out-of-fold")


def stacked(df: DataFrame, features: list[str], row: str, label: str, bases: list[Base] | None = None, k: int = 5, meta: str = "logreg") -> DataFrame:
    """(row, label, fold, a column a base model, prob): out-of-fold base predictions and a meta model over them.

    No row is told from another of the same features, label and fold, so these go through all steps as one, with their number.
    """
    bases = [Base.surveyed(b) for b in ("svm", "lr", "rf", "gbdt")] if bases is None else bases
    names = [b.name for b in bases]
    rows = with_folds(df, features, row, label, k)
    equal = ["x", "label", "fold"]
    data = stored(rows.groupBy(*equal).agg(F.count("*").alias("n")), "equal-rows")
    oof = _base_scores(data, rows, [*equal, "n"], len(features), bases, [*range(k)], "n", together=True)
    if meta == "mlp":
        oof = rows.join(oof, equal).select(row, "label", "fold", *names)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(oof)
        estimator = MultilayerPerceptronClassifier(layers=[len(names), 16, 8, 2], maxIter=100, seed=42, labelCol="label")
        return predicted(estimator.fit(vectors), vectors, "prob", row, "label", "fold", *names)
    oof = oof.withColumn("p", F.array(*names))
    models = [Linear("prob", c=C["logreg"])]
    found = scored(oof, models, fitted(oof, models, "p", n="n"), [*equal, *names], "p")
    return rows.join(found, equal).select(row, "label", "fold", *names, "prob")


def logreg_scores(df: DataFrame, features: list[str], row: str, label: str, test: str, c: float = C["lr"]) -> DataFrame:
    """(row, label, is_test, prob): a logistic regression fitted on the rows of which `test` is false, scores of all rows."""
    base = Base("prob", "lr", c)
    rows = df.select(row, F.col(label).cast("double").alias("label"), F.coalesce(F.col(test), F.lit(False)).alias("is_test"), *[F.col(f).cast("double").alias(f) for f in features])
    ends = F.broadcast(rows.where("not is_test").agg(*[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features]))  # one row
    x = F.array(*[F.coalesce(scaled(F.col(f), F.col(f"_lo_{f}"), F.col(f"_hi_{f}")), F.lit(0.0)) for f in features]).alias("x")
    data = stored(rows.join(ends).select(row, "label", "is_test", x), "scaled")
    models = [base.linear(None)]
    return scored(data, models, fitted(data.where("not is_test"), models), [row, "label", "is_test"])


def random_features(x: Column, width: int, n: int, gamma: Column, seed: int = 42) -> Column:
    """An array of n random Fourier features of a vector column: their inner products approach exp(-gamma * |a - b|**2).

    Directions and phases are constants drawn from a seed; only the scale, which may come from the data, is a column.
    """
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(n, width)), rng.uniform(0, 2 * np.pi, n)
    matrix = F.lit(directions.tolist())
    angle = lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) * F.sqrt(2 * gamma)
    return F.zip_with(F.transform(matrix, angle), F.lit(phases.tolist()), lambda a, b: F.cos(a + b) * float(np.sqrt(2 / n)))


def fourier(width: int, n: int, gamma: float, seed: int = 42):
    """The same features, of the rows of a matrix: they are made where they are used, so none are stored."""
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(n, width)), rng.uniform(0, 2 * np.pi, n)

    def lift(v: np.ndarray) -> np.ndarray:
        return np.cos(v @ directions.T * np.sqrt(2 * gamma) + phases) * np.sqrt(2 / n)

    return lift


def rbf_svm(df: DataFrame, features: list[str], row: str, label: str, test: str, c: float = 10.0, n: int = 200, seed: int = 42) -> DataFrame:
    """(row, label, is_test, prob): a support vector machine with a Gaussian kernel, by `n` random Fourier features.

    Features are scaled to the ranges of the rows of which `test` is false, on which it is fitted. gamma is 1 / (features * variance of
    all scaled values of these rows). `prob` is the sigmoid of the decision, 0.5 at the boundary.
    """
    rows = df.select(row, F.col(label).cast("double").alias("label"), F.coalesce(F.col(test), F.lit(False)).alias("is_test"), *[F.col(f).cast("double").alias(f) for f in features])
    ends = F.broadcast(rows.where("not is_test").agg(*[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features]))  # one row
    x = F.array(*[F.coalesce(scaled(F.col(f), F.col(f"_lo_{f}"), F.col(f"_hi_{f}")), F.lit(0.0)) for f in features]).alias("v")
    data = stored(rows.join(ends).select(row, "label", "is_test", x), "scaled")
    variance = data.where("not is_test").select(F.explode("v").alias("c")).agg(F.var_pop("c").alias("v")).first().v
    gamma = 1.0 / (len(features) * variance) if variance else 1.0
    models, lift = [Linear("prob", "hinge", c)], fourier(len(features), n, gamma, seed)
    return scored(data, models, fitted(data.where("not is_test"), models, "v", tolerance=1e-5, lift=lift), [row, "label", "is_test"], "v", lift=lift)


#: Surveyed ranges of the search, as powers of ten.
TRIALS = {"svm_c": (-0.5, 1.7), "lr_c": (-1.0, 1.5), "meta_c": (-1.3, 1.5)}


#: Surveyed choices of the search for trees: number, depth (None: no bound) and least rows of a leaf of the forest; rounds, depth and step of the boosted trees.
TRIAL_TREES = {
    "rf_trees": (200, 300, 400, 600, 800), "rf_depth": (None, 8, 12, 16, 20), "rf_least": (1, 2, 3, 4),
    "gbdt_rounds": (250, 400, 600, 800), "gbdt_depth": (4, 6, 8, 10), "gbdt_step": (0.03, 0.05, 0.08, 0.1),
}


def drawn_trials(n: int, seed: int = 42, trees: dict[str, tuple] | None = None) -> list[dict]:
    """`n` trials with log-uniform weights of the losses and, of each of `trees`, one of its choices; the same for each seed."""
    rng, own = np.random.default_rng(seed), np.random.default_rng([seed, 1])
    drawn = [{"trial": i + 1, **{k: float(10 ** rng.uniform(*ends)) for k, ends in TRIALS.items()}} for i in range(n)]
    return [{**t, **{k: v[own.integers(len(v))] for k, v in (trees or {}).items()}} for t in drawn]


def trial_scores(oof: DataFrame, row: str, trials: list[dict], columns: list[list[str]], n: str | None = None) -> DataFrame:
    """(trial, row, label, prob): each trial's meta model, fitted on rows with a fold, over its columns, for the rows without.

    `n` names a column with the rows that a row stands for; it may be `row`.
    """
    names = list(dict.fromkeys(c for own in columns for c in own))
    data = oof.select(row, *([n] if n not in (None, row) else []), "label", "fold", F.array(*names).alias("x"))
    models = [Linear(f"t{t['trial']}", "logistic", t["meta_c"], tuple(names.index(c) for c in own)) for t, own in zip(trials, columns)]
    wide = scored(data.where("fold < 0"), models, fitted(data.where("fold >= 0"), models, n=n), [row, "label"])
    each = F.explode(F.array(*[F.struct(F.lit(t["trial"]).alias("trial"), F.col(m.name).alias("prob")) for t, m in zip(trials, models)]))
    return wide.select(row, "label", each.alias("t")).select("t.trial", row, "label", "t.prob")


def trial_report(scores: DataFrame, trial: str = "trial", label: str = "label", n: str | None = None) -> DataFrame:
    """(trial, auc, tpr1, accuracy, best): metrics of every trial from one pass over (trial, label, prob), and which trial
    is the best by (auc, tpr1, accuracy), the first among equals. `n` names a column with the rows that a row stands for."""
    m = curve_metrics(score_steps(scores, trial, gt=label, n=n), trial).select(trial, "auc", F.col("nearest.tpr").alias("tpr1"), "accuracy")
    m = stored(m, "trials")  # a row a trial
    return m.join(F.broadcast(m.agg(F.max_by(trial, F.struct("auc", "tpr1", "accuracy", -F.col(trial))).alias("_best")))).withColumn("best", F.col(trial) == F.col("_best")).drop("_best")


def ensemble_search(df: DataFrame, features: list[str], row: str, label: str, test: str, n: int = 12, k: int = 5, others: list[Base] | None = None, seed: int = 42, sizes: dict[str, tuple] = TRIAL_TREES) -> DataFrame:
    """(trial, svm_c, lr_c, meta_c, a column a kind of `sizes`, auc, tpr1, accuracy, best): random search over the stack.

    Each trial draws the weights of its linear models and of the meta model, and the sizes of a forest and of boosted trees of its own.
    With `others`, base models that all trials share stand in for the trees. The models of all trials are fitted together, their
    out-of-fold scores are one stored table, and meta models are fitted together and measured on the test rows in one pass. No row is told
    from another of the same features, label and fold, so these go through all steps as one, with their number.
    """
    sizes = sizes if others is None else {}
    trials = drawn_trials(n, seed, sizes)

    def bases(t: dict) -> list[Base]:
        linear = [Base(f"svm{t['trial']}", "svm", t["svm_c"]), Base(f"lr{t['trial']}", "lr", t["lr_c"])]
        if others is not None:
            return linear
        return [*linear, *[Base(f"{kind}{t['trial']}", kind, sizes=tuple(t[f"{kind}_{c}"] for c in own)) for kind, own in (("rf", ("trees", "depth", "least")), ("gbdt", ("rounds", "depth", "step")))]]

    own, shared = [bases(t) for t in trials], others or []
    rows = with_folds(df, features, row, label, k, test)
    data = stored(rows.groupBy("x", "label", "fold").agg(F.count("*").alias("n")), "equal-rows")
    oof = _base_scores(data, rows, ["label", "fold", "n"], len(features), [b for bs in own for b in bs] + shared, [*range(k), None], "n", together=True)
    report = trial_report(trial_scores(oof, "n", trials, [[b.name for b in [*bs, *shared]] for bs in own], "n"), n="n")
    kinds = {c: "double" if c in TRIALS or c == "gbdt_step" else "int" for c in ["trial", *TRIALS, *sizes]}
    configs = df.sparkSession.createDataFrame([tuple(t[c] for c in kinds) for t in trials], ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    return configs.join(report, "trial")


def _leaves(df: DataFrame, features: list[str], label: str, trees: int, depth: int, of: DataFrame | None = None, row: str | None = None) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(rows, cells, words): `of` as (row, label, bins); cells of `df`; and (bins, tree, leaf, token, unknown) of all bins, by a forest over `df`."""
    ends = df.agg(*[F.min(f).cast("double").alias(f"_lo_{f}") for f in features], *[F.max(f).cast("double").alias(f"_hi_{f}") for f in features])  # one row
    x = F.array(*[F.coalesce(scaled(F.col(f).cast("double"), F.col(f"_lo_{f}"), F.col(f"_hi_{f}")), F.lit(0.0)) for f in features]).alias("x")
    vectors = lambda d, *keep: d.join(F.broadcast(ends)).select(*keep, F.col(label).cast("double").alias("label"), x)
    known = stored(vectors(df), "vectors")
    own = cells(binned(known, known, len(features)), "label")
    rows = None if of is None else binned(vectors(of, row), known, len(features), keep=[row, "label"])
    forest = grown_on(RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=42, leafCol="leaf", labelCol="label", maxMemoryInMB=512), own)
    bins = own.select("bins", F.lit(True).alias("own"))
    bins = bins if rows is None else bins.unionByName(rows.select("bins", F.lit(False).alias("own")))
    bins = bins.groupBy("bins").agg(F.max("own").alias("own")).withColumn("features", array_to_vector("bins"))
    at = stored(forest.transform(bins).select("bins", "own", vector_to_array("leaf").alias("leaf")), "leaves")
    at = at.select("bins", "own", F.posexplode("leaf").alias("tree", "leaf"))
    known = at.where("own").select("tree", "leaf").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("tree").orderBy("leaf")))
    known = stored(known, "known")
    before = F.sum("size").over(Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1))
    starts = known.groupBy("tree").agg((F.count("*") + 1).alias("size")).select("tree", F.coalesce(before, F.lit(0)).alias("unknown"))
    words = at.join(F.broadcast(known), ["tree", "leaf"], "left").join(F.broadcast(starts), "tree")
    return rows, own, words.select("bins", "tree", "leaf", (F.col("unknown") + F.coalesce("nth", F.lit(0))).alias("token"), "unknown")


def leaf_tokens(df: DataFrame, features: list[str], row: str, label: str, trees: int = 128, depth: int = 12, of: DataFrame | None = None) -> DataFrame:
    """(row, label, tree, leaf, token, unknown): leaves of a forest over `df` as tokens, for the rows of `of` or else of `df`.

    A tree's range of tokens starts with its unknown token, for leaves that no row of `df` has, and goes on with its leaves
    in order. The vocabulary has 2**depth leaves a tree at most, whatever the number of rows. Features are scaled by the ranges of `df`.
    """
    rows, _, words = _leaves(df, features, label, trees, depth, df if of is None else of, row)
    return rows.select(row, "label", "bins").join(words, "bins").select(row, "label", "tree", "leaf", "token", "unknown")


def cell_tokens(df: DataFrame, features: list[str], label: str, trees: int = 128, depth: int = 12) -> DataFrame:
    """(label, n, tree, leaf, token, unknown): the same of all rows that agree in label and cell, with their number."""
    _, own, words = _leaves(df, features, label, trees, depth)
    return own.join(words, "bins").select("label", "n", "tree", "leaf", "token", "unknown")


def leaf_stats(tokens: DataFrame, n: str | None = None) -> DataFrame:
    """(tree, leaf, token, pos_rate, log_count, impurity): the share of positive rows, kept off 0 and 1, and log1p of the
    count; a tree's unknown token, with leaf null, has the share of all rows and no count. `n` names a column with the rows that a token stands for."""
    kept = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))
    weight = F.lit(1).cast("long") if n is None else F.col(n)
    sums = tokens.groupBy("tree", "leaf", "token", "unknown").agg(F.sum(F.col("label") * weight).alias("s"), F.sum(F.when(F.col("label").isNotNull(), weight)).alias("m"), F.sum(weight).alias("n"))
    sums = stored(sums, "leaf-sums")  # a row a leaf
    p = F.try_divide(F.col("s"), F.col("m"))
    g = sums.select("tree", "leaf", "token", kept(p).alias("pos_rate"), F.log1p("n").alias("log_count"), (2 * p * (1 - p)).alias("impurity"))
    unknown = sums.groupBy("tree", F.col("unknown").alias("token")).agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    none = unknown.select("tree", F.lit(None).cast("double").alias("leaf"), "token", kept(p).alias("pos_rate"), F.lit(0.0).alias("log_count"), F.lit(0.0).alias("impurity"))
    return g.unionByName(none)


def trial_table(trials: DataFrame) -> DataFrame:
    """The best trial by (auc, tpr1, accuracy)."""
    return trials.agg(F.max_by(F.struct(*trials.columns), F.struct("auc", "tpr1", "accuracy")).alias("t")).select("t.*")
