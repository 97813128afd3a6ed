"""Rule-based feasibility of loading orders into a bin, with reasons, features and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palletry.functions.numeric import ratio, sorted_dims
from palletry.sources.io import dealt

# The default bin and the thresholds of the rules.
BIN = (60.0, 25.0, 30.0)
VOLUME_SHARE, SPREAD, SPREAD_FILL, SPREAD_STD, HIGH_FILL, BLOCK, CONNECT = 0.98, 2.8, 0.15, 0.3, 0.95, 0.95, 1.2
EXTREME_MIDDLE, EXTREME_FILL, EXTREME_LEAST, EXTREME_ITEMS = 0.85, 0.85, 0.15, 10


def order_features(items: DataFrame, order: str = "dispatch_id", seq: str = "seq", box: tuple[float, float, float] = BIN, tasks: int | None = None) -> DataFrame:
    """One row for each order of item rows (order, seq, length, width, height): sides are sorted, item by item.

    `first_big`, `first_over`: where an item exceeds the bin, and where the volume so far does, in order of `seq`. `tasks` is their number, or else the session's.
    """
    low, middle, high = sorted(box)
    volume = box[0] * box[1] * box[2]
    a, b, c = sorted_dims(F.col("length").cast("double"), F.col("width").cast("double"), F.col("height").cast("double"))
    d = items.select(order, seq, a.alias("a"), b.alias("b"), c.alias("c"), (F.col("length").cast("double") * F.col("width") * F.col("height")).alias("v"))
    d = dealt(d, tasks, order).withColumn("upto", F.sum("v").over(Window.partitionBy(order).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    big = (F.col("c") > high) | (F.col("b") > middle) | (F.col("a") > low)
    asr = F.when(F.col("a") > 0, F.col("c") / F.col("a"))
    return d.groupBy(order).agg(
        F.count("*").alias("item_count"),
        F.count_distinct(F.col("a").cast("int"), F.col("b").cast("int"), F.col("c").cast("int")).alias("distinct_types"),
        F.sum("v").alias("total_vol"),
        (F.sum("v") / volume).alias("fill_ratio"),
        F.sum("a").alias("a_sum"), F.stddev_pop("a").alias("a_std"), F.min("a").alias("a_min"), F.max("a").alias("a_max"),
        F.min("b").alias("b_min"), F.max("b").alias("b_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
        F.max(asr).alias("asr_max"), F.avg(asr).alias("asr_avg"),
        F.min(F.when(big, F.col(seq))).alias("first_big"), F.min(F.when(F.col("upto") > volume, F.col(seq))).alias("first_over"),
    )


def with_reason(features: DataFrame, box: tuple[float, float, float] = BIN) -> DataFrame:
    """Order features with `reason`, of which `pass` alone means feasible."""
    low, middle, high = sorted(box)
    volume = box[0] * box[1] * box[2]
    c = F.col
    fill = c("fill_ratio")
    limit = SPREAD * high * (1 - SPREAD_FILL * fill) + SPREAD_STD * c("a_std")
    reason = (
        F.when(c("first_big").isNotNull() & (c("first_over").isNull() | (c("first_big") <= c("first_over"))), "single_item_dimension_exceed")
        .when(c("first_over").isNotNull(), "volume_overflow_early")
        .when(c("total_vol") > volume * VOLUME_SHARE, "volume_overflow_98pct")
        .when(c("a_sum") > limit, "variance_compensated_fragmentation")
        .when((fill > HIGH_FILL) & (c("c_max") / high > BLOCK), "high_fill_max_dim_block")
        .when((fill > HIGH_FILL) & (low * F.sqrt(F.greatest(1 - fill, F.lit(0.0))) < c("a_min") * CONNECT), "high_fill_connectivity_block")
        .when((c("b_max") / middle > EXTREME_MIDDLE) & (fill > EXTREME_FILL) & (c("a_min") / low < EXTREME_LEAST) & (c("item_count") > EXTREME_ITEMS), "extreme_dimension_distribution")
        .otherwise("pass")
    )
    return features.withColumn("reason", reason).withColumn("feasible", F.col("reason") == "pass")


def error_report(judged: DataFrame, gt: str = "gt") -> DataFrame:
    """One row: counts of orders, classes and errors, and their rates in per cent."""
    ok, yes = F.col("feasible"), F.col(gt) == 1
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    r = judged.agg(F.count("*").alias("n"), n(yes).alias("n_positive"), n(~yes).alias("n_negative"), n(yes & ~ok).alias("fn"), n(~yes & ok).alias("fp"))
    return r.withColumns({"fn_pct": 100 * ratio(F.col("fn"), F.col("n_positive")), "fp_pct": 100 * ratio(F.col("fp"), F.col("n_negative"))})


def typical_errors(judged: DataFrame, order: str = "dispatch_id", gt: str = "gt", n: int = 2) -> DataFrame:
    """The n most typical errors of each kind: frequent reason, high fill, many items, many types, small id."""
    e = judged.where((F.col(gt) == 1) != F.col("feasible")).withColumn("kind", F.when(F.col(gt) == 1, "FN").otherwise("FP"))
    counts = e.groupBy("kind", "reason").agg(F.count("*").alias("reason_n"))
    e = e.join(F.broadcast(counts), ["kind", "reason"])  # two kinds of eight reasons
    by = [F.desc("reason_n"), F.desc(F.round("fill_ratio", 9)), F.desc("item_count"), F.desc("distinct_types"), F.col(order)]
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*by)))
    return e.where(F.col("rank") <= n).select("kind", "rank", order, "reason", "reason_n", "fill_ratio", "item_count", "distinct_types")


def top_types(items: DataFrame, order: str = "dispatch_id", seq: str = "seq", k: int = 3) -> DataFrame:
    """The k most frequent item types of each order, first seen first among equals."""
    a, b, c = sorted_dims(F.col("length").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"))
    t = items.select(order, seq, a.alias("a"), b.alias("b"), c.alias("c")).groupBy(order, "a", "b", "c").agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy(order).orderBy(F.desc("n"), "first_seq")))
    return t.where(F.col("rank") <= k).drop("first_seq")
