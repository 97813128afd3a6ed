"""Confusion counts, ROC curves and comparisons, as aggregations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import ratio
from palletry.functions.text import fixed
from palletry.operators.population import range_of
from palletry.sources.snapshots import stored


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(df: DataFrame, *by: str, gt: str = "gt", pred: str = "pred") -> DataFrame:
    g, p = F.col(gt), F.col(pred)
    return df.groupBy(*by).agg(
        count_if((g == 0) & (p == 0)).alias("tn"), count_if((g == 0) & (p == 1)).alias("fp"), count_if((g == 1) & (p == 0)).alias("fn"), count_if((g == 1) & (p == 1)).alias("tp")
    )


def classification(df: DataFrame, *by: str, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Confusion counts with accuracy, precision, recall, FPR and FNR; 0 where a denominator is 0."""
    c = F.col
    return confusion(df, *by, gt=gt, pred=pred).withColumns(
        {
            "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")),
            "precision": ratio(c("tp"), c("tp") + c("fp")),
            "recall": ratio(c("tp"), c("tp") + c("fn")),
            "fpr": ratio(c("fp"), c("fp") + c("tn")),
            "fnr": ratio(c("fn"), c("fn") + c("tp")),
        }
    )


def score_steps(df: DataFrame, *by: str, gt: str = "gt", score: str = "prob", n: str | None = None) -> DataFrame:
    """(by, part, threshold, pos, neg, fp, tp, all_pos, all_neg, next): one row a distinct score of each group, the greatest
    first, with counts up to it and those of the step after it.

    Counts by score are stored once, and only they are read from then on. They are summed in two levels, ranges of the score
    first, so that a curve of any number of scores is no single task. Null scores come last. `n` names a column with the rows that a row
    stands for.
    """
    label, weight = F.col(gt).cast("long"), F.lit(1).cast("long") if n is None else F.col(n)
    by_score = stored(df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(label * weight).alias("pos"), F.sum((1 - label) * weight).alias("neg")), "scores")
    d = by_score.withColumn("_down", F.coalesce(-F.col("threshold"), F.lit(float("inf"))))
    d = d.withColumn("part", range_of(d, "_down"))
    parts = Window.partitionBy(*by).orderBy("part")  # of a row a range
    before, everything = parts.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    ends = d.groupBy(*by, "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min_by(F.struct("pos", "neg"), "_down").alias("first"))
    ends = ends.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("part").alias("_part"),
        F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("fp0"),
        F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("tp0"),
        F.lead("first").over(parts).alias("beyond"),
        F.sum("neg").over(everything).alias("all_neg"),
        F.sum("pos").over(everything).alias("all_pos"),
    )
    inside = Window.partitionBy(*by, "part").orderBy("_down")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"fp1": F.sum("neg").over(upto), "tp1": F.sum("pos").over(upto), "next": F.lead(F.struct("pos", "neg")).over(inside)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("part") == F.col("_part"))
    return d.join(ends, same).select(
        *by, "part", "_down", "threshold", "pos", "neg", (F.col("fp0") + F.col("fp1")).alias("fp"), (F.col("tp0") + F.col("tp1")).alias("tp"), "all_pos", "all_neg", F.coalesce("next", "beyond").alias("next")
    )


def _bent() -> Column:
    """Whether a step ends a straight piece of the curve: between equal steps it doesn't; the first and the last do."""
    first = (F.col("fp") == F.col("neg")) & (F.col("tp") == F.col("pos"))
    return first | F.col("next").isNull() | (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))


def roc_points(df: DataFrame, gt: str = "gt", score: str = "prob", drop: bool = True) -> DataFrame:
    """(place, threshold, fp, tp, fpr, tpr): one point a distinct score, from (0, 0) on; collinear ones are dropped.

    Scores are exact; null ones come last. Only one row a range of the score meets in an unpartitioned window.
    """
    steps = score_steps(df, gt=gt, score=score)
    points = steps.where(_bent()) if drop else steps
    points = points.select("part", "_down", "threshold", "fp", "tp", ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), ratio(F.col("tp"), F.col("all_pos")).alias("tpr"))
    count = points.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("_down")) + 1
    points = points.join(count, "part").select(place.alias("place"), "threshold", "fp", "tp", "fpr", "tpr")
    none = F.lit(0).cast("long")
    start = df.sparkSession.range(1).select(F.lit(1).cast("long").alias("place"), F.lit(float("inf")).alias("threshold"), none.alias("fp"), none.alias("tp"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def curve_metrics(steps: DataFrame, *by: str, at: float = 0.01) -> DataFrame:
    """(by, auc, nearest, tpr_interp, accuracy) of the groups of `score_steps`, in one aggregation.

    `nearest` is the curve's point (threshold, fpr, tpr) of the FPR nearest to `at`, the first among equals, and
    `tpr_interp` the TPR there by linear interpolation. `accuracy` is that of scores from 0.5 on as positive. The curve
    starts at (0, 0). Rates of a class without rows are 0, and so is the area then.
    """
    fpr, tpr = ratio(F.col("fp"), F.col("all_neg")), ratio(F.col("tp"), F.col("all_pos"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    point = F.when(_bent(), F.struct("threshold", fpr.alias("fpr"), tpr.alias("tpr")))
    place = F.when(_bent(), F.struct(F.abs(fpr - at), "fp", "tp"))
    right = F.when(F.col("threshold") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    steps_to = F.struct("fp", "tp", "next")
    g = steps.groupBy(*by).agg(
        area.alias("area"), F.min_by(point, place).alias("point"), F.sum(right).alias("right"), F.first("all_pos").alias("p"), F.first("all_neg").alias("n"),
        F.max_by(steps_to, F.when(fpr <= at, F.struct("fp", "tp"))).alias("last"), F.min_by(steps_to, F.struct("fp", "tp")).alias("first"),
    )
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    nearest = F.when(F.abs(F.col("point.fpr") - at) < at, F.col("point")).otherwise(origin)
    whole = lambda c, t: ratio(c, F.col(t))
    x1, y1 = (F.when(F.col("last").isNull(), 0.0).otherwise(whole(F.col(f"last.{a}"), b)) for a, b in (("fp", "n"), ("tp", "p")))
    after = lambda a, b, t: F.when(F.col("last").isNull(), whole(F.col(f"first.{a}"), t)).otherwise(whole(F.col(f"last.{a}") + F.col(f"last.next.{b}"), t))
    x2, y2 = after("fp", "neg", "n"), after("tp", "pos", "p")
    between = F.when(x2.isNull() | (x2 <= x1), y1).otherwise(y1 + (y2 - y1) * (at - x1) / (x2 - x1))
    return g.select(*by, F.coalesce(F.try_divide(F.col("area"), (F.col("p") * F.col("n")).cast("double")), F.lit(0.0)).alias("auc"), nearest.alias("nearest"), F.coalesce(between, F.lit(0.0)).alias("tpr_interp"), ratio(F.col("right"), F.col("p") + F.col("n")).alias("accuracy"))


def _after(points: DataFrame) -> DataFrame:
    """`points` with fpr2 and tpr2 of the next place, null at the end."""
    return points.join(points.select((F.col("place") - 1).alias("place"), F.col("fpr").alias("fpr2"), F.col("tpr").alias("tpr2")), "place", "left")


def auc(points: DataFrame) -> DataFrame:
    """Area under ROC points by trapezoids."""
    step = (F.col("fpr2") - F.col("fpr")) * (F.col("tpr2") + F.col("tpr")) / 2
    return _after(points).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("auc"))


def tpr_nearest(points: DataFrame, at: float = 0.01) -> DataFrame:
    """The curve point of nearest FPR, the first among equals."""
    return points.orderBy(F.abs(F.col("fpr") - at), "place").limit(1).select("threshold", "fpr", "tpr")


def tpr_interpolated(points: DataFrame, at: float = 0.01) -> DataFrame:
    """TPR at an FPR by linear interpolation between the curve's points, clamped at its ends."""
    p = _after(points.select("place", "fpr", "tpr"))
    slope = F.when(F.col("fpr2") > F.col("fpr"), F.col("tpr") + (F.col("tpr2") - F.col("tpr")) * (at - F.col("fpr")) / (F.col("fpr2") - F.col("fpr"))).otherwise(F.col("tpr"))
    last = p.where((F.col("fpr") <= at)).orderBy(F.desc("place")).limit(1)
    return last.select(F.lit(at).alias("fpr"), F.when(F.col("fpr2").isNull(), F.col("tpr")).otherwise(slope).alias("tpr"))


def hard_rows(df: DataFrame, fn: Column | None = None, fp: Column | None = None) -> DataFrame:
    """The rows that a comparison is restricted to: those of either mask; of `fp` where there is no `fn`; all without masks."""
    if fn is None:
        return df if fp is None else df.where(fp)
    if fp is None:
        raise ValueError("a mask of missed rows needs one of false alarms")
    return df.where(fn | fp)


def deltas(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(metric, before, after, delta, direction) of two one-row frames."""
    long = lambda df, n: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in names])).alias("x")).select("x.*")
    both = long(a, "before").join(long(b, "after"), "metric")
    d = F.col("after") - F.col("before")
    return both.withColumns({"delta": d, "direction": F.when(d > 0, "up").when(d < 0, "down").otherwise("same")})


def ratio_summary(df: DataFrame, part: str, whole: str, label: str) -> DataFrame:
    """One row: the mean label, and mean, greatest and least of `part` against the mean of `whole`."""
    over = lambda f: ratio(f(part), F.avg(whole), None)
    return df.agg(F.avg(label).alias("mean_label"), over(F.avg).alias("mean_ratio"), over(F.max).alias("max_ratio"), over(F.min).alias("min_ratio"))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A summary table as a markdown document; one of more than `most` rows is an error, as it is no summary."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "—" if v is None else (f"{v:.6g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return f"# {title}\n\n" + "\n".join("|" + "|".join(line) + "|" for line in lines) + "\n"


def run_overview(runs: DataFrame) -> DataFrame:
    """Runs as a report's texts, one row each: model, run, timestamp, resumed, accuracies, their difference, best rule score.

    `runs` has the columns of `sources.io.read_runs`. A model without name takes that of its folder below `by_model`.
    """
    dash = lambda c: F.coalesce(c, F.lit("\u2014"))
    folder = F.nullif(F.regexp_extract("path", r"/by_model/([^/]+)/", 1), F.lit(""))
    model = F.coalesce(F.nullif(F.col("llm_model"), F.lit("")), folder)
    before, after = F.col("svm.accuracy"), F.col("hybrid.accuracy")
    since = F.concat(F.lit("yes (from "), F.coalesce(F.col("resume_start_iteration").cast("string"), F.lit("?")), F.lit(")"))
    return runs.select(
        dash(model).alias("model"),
        "run",
        dash(F.col("timestamp")).alias("timestamp"),
        F.when(F.col("resumed"), since).otherwise("no").alias("resumed"),
        dash(fixed(before)).alias("svm_accuracy"),
        dash(fixed(after)).alias("hybrid_accuracy"),
        dash(fixed(after - before, 4, sign=True)).alias("delta"),
        dash(fixed(F.col("hybrid.best_rule_score"), 6)).alias("best_rule_score"),
        *([F.col("n_rules")] if "n_rules" in runs.columns else []),
    )


def weighted_average(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(key).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("average"))
