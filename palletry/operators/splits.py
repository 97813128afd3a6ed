"""Reproducible splits: by hash, by class and by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palletry.functions.numeric import hash_fraction


def hash_split(df: DataFrame, key: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """`df` with `is_test`, from a hash of the key alone: no shuffle."""
    return df.withColumn("is_test", hash_fraction(F.col(key), seed=seed) < test)


def hashed_rank(df: DataFrame, key: str, label: str, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """`df` with `nth` (from 1) and `n`: the place of each row among those of its label, in hashed order, and their number.

    Two levels, so a label is not one task: rows are ranked inside buckets of the hash, after the buckets' counts are
    summed up. The counts, `buckets` rows a label, are all that is joined.
    """
    u = hash_fraction(F.col(key), seed=seed)
    d = df.withColumns({"_u": u, "_b": F.floor(u * buckets)})
    counts = d.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_l")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_l", "_c", before.alias("_before"), F.sum("_n").over(own).alias("n"))
    d = d.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    inside = F.row_number().over(Window.partitionBy("_l", "_c").orderBy("_u", key))
    return d.withColumn("nth", F.col("_before") + inside).drop("_u", "_b", "_l", "_c", "_before")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.15, seed: int = 42) -> DataFrame:
    """`df` with `is_test`: the same share of each class."""
    return hashed_rank(df, key, label, seed).withColumn("is_test", F.col("nth") <= F.round(F.col("n") * test)).drop("nth", "n")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """`df` with `fold`: each class dealt to k folds in turn, in hashed order."""
    return hashed_rank(df, key, label, seed).withColumn("fold", ((F.col("nth") - 1) % k).cast("int")).drop("nth", "n")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_fraction(F.col(key), seed=seed), key)
