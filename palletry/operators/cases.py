"""Error cohorts: classification of cases, summaries, typical and confusable cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palletry.functions.numeric import l2


def classified(df: DataFrame, gt: str = "gt", prob: str = "prob", hard: str | None = None) -> DataFrame:
    """`df` with pred (given labels win over the threshold 0.5, which is positive) and error_type FN, FP, TN or TP."""
    cut = (F.col(prob) >= 0.5).cast("int")
    pred = F.coalesce(F.col(hard).cast("int"), cut) if hard else cut
    kind = F.when((F.col(gt) == 1) & (pred == 0), "FN").when((F.col(gt) == 0) & (pred == 1), "FP").when(F.col(gt) == 0, "TN").otherwise("TP")
    return df.withColumns({"pred": pred, "error_type": kind})


def summary(cases: DataFrame, prob: str = "prob") -> DataFrame:
    """(error_type, gt, n, pct, mean_prob, std_prob): pct is of the class gt, std is the population's."""
    s = cases.groupBy("error_type", "gt").agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.stddev_pop(prob).alias("std_prob"))
    return s.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("gt")))


def long_features(cases: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep..., nth, feature, value), NaN as null."""
    parts = [F.struct(F.lit(i).alias("nth"), F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("value")) for i, f in enumerate(features)]
    return cases.select(*keep, F.explode(F.array(*parts)).alias("x")).select(*keep, "x.*")


def top_variance(cases: DataFrame, features: list[str], k: int) -> DataFrame:
    """The k features of greatest population variance of each error type, ties in column order."""
    v = long_features(cases, features, "error_type").groupBy("error_type", "feature", "nth").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    order = Window.partitionBy("error_type").orderBy(F.desc(F.round("var", 6)), "nth")
    return v.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("error_type", "rank", "feature", "mean", "var")


def typical(cases: DataFrame, n: int, easy: bool, row: str = "row_id", prob: str = "prob") -> DataFrame:
    """The n most confident errors, or the n least confident right answers, of each type."""
    kinds = ["TN", "TP"] if easy else ["FN", "FP"]
    far = F.round(F.abs(F.col(prob) - 0.5), 6)
    order = Window.partitionBy("error_type").orderBy(far.asc() if easy else far.desc(), row)
    c = cases.where(F.col("error_type").isin(kinds)).withColumn("rank", F.row_number().over(order))
    return c.where(F.col("rank") <= n).select("error_type", "rank", row, "gt", prob)


def centroid(cases: DataFrame, features: list[str]) -> DataFrame:
    return cases.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f"_c_{f}") for f in features])


def near_confusable(cases: DataFrame, hard: str, easy: str, features: list[str], k: int, row: str = "row_id") -> DataFrame:
    """The k right answers of type `easy` nearest to the centroid of the errors of type `hard`; a missing value is no distance."""
    c = F.broadcast(centroid(cases.where(F.col("error_type") == hard), features))  # one row
    d = cases.where(F.col("error_type") == easy).join(c).withColumn("distance", F.round(l2((F.col(f).cast("double"), F.col(f"_c_{f}")) for f in features), 6))
    return d.orderBy("distance", row).limit(k).select(row, "error_type", "distance")
