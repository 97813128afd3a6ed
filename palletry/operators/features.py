"""Feature tables: item types, per-order features, deduplication, quantiles, bins and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import scaled, sorted_dims
from palletry.operators.cases import long_features
from palletry.operators.population import running_total
from palletry.sources.snapshots import stored


def item_types(items: DataFrame, labels: DataFrame, order: str = "dispatch_id", strict: bool = False, tasks: int | None = None) -> DataFrame:
    """(order, if_loaded, n_types, dim_s, dim_m, dim_l, n_items): counts of equal boxes, turned to sorted sides.

    An order without label is left out, or an error if `strict`. Items are shuffled once, by order, which serves the aggregation, the window and
    the join; boxes of one size are too rare in an order for combining by size first to pay. `tasks` is their number, or else the session's.
    """
    s, m, l = sorted_dims(F.col("length"), F.col("width"), F.col("height"))
    sides = items.select(order, s.alias("dim_s"), m.alias("dim_m"), l.alias("dim_l"))
    typed = (sides.repartition(order) if tasks is None else sides.repartition(tasks, order)).groupBy(order, "dim_s", "dim_m", "dim_l").agg(F.count("*").alias("n_items"))
    typed = typed.withColumn("n_types", F.count("*").over(Window.partitionBy(order)))
    labelled = required(typed, labels, order, "if_loaded") if strict else typed.join(labels.select(order, "if_loaded"), order)
    return labelled.select(order, "if_loaded", "n_types", "dim_s", "dim_m", "dim_l", "n_items")


def required(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """`df` with a looked-up value; a row whose key has none fails the job with the key in its message."""
    lacking = F.raise_error(F.concat(F.lit(f"Missing {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.when(F.col(value).isNull(), lacking.cast(lookup.schema[value].dataType)).otherwise(F.col(value)))


def same_orders(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row (n, expected): distinct keys of both; an error if their numbers differ."""
    count = lambda d, name: d.agg(F.count_distinct(key).alias(name))
    both = count(df, "n").crossJoin(F.broadcast(count(expected, "expected")))  # one row each
    differ = F.raise_error(F.format_string("%d of %d keys", "n", "expected")).cast("long")
    return both.select(F.when(F.col("n") != F.col("expected"), differ).otherwise(F.col("n")).alias("n"), "expected")


def keep_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by a total order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_known(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the last row's value that isn't null."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """`df` with a looked-up value, the default where the key has none."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def select_numeric(df: DataFrame, drop: tuple[str, ...] = (), first: tuple[str, ...] = (), most: int = 48) -> list[str]:
    """Numeric columns outside a drop list, those named first in front, at most `most`."""
    numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") and c not in drop]
    return ([c for c in first if c in numeric] + [c for c in numeric if c not in first])[:most]


def _value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, m): how often each value occurs, stored once; nulls and NaN are left out."""
    return stored(long_features(df, features).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("m")), "values")


def _quantiles(counts: DataFrame) -> DataFrame:
    all_rows = counts.groupBy("feature").agg(F.sum("m").alias("n"))  # one row a feature
    d = running_total(counts, "value", "m", "feature").join(F.broadcast(all_rows), "feature")
    first, last = F.col("total") - F.col("m"), F.col("total") - 1  # places of a value, from 0

    def at(p: float) -> Column:
        place = (F.col("n") - 1) * p
        value = lambda i: F.max(F.when((first <= i) & (i <= last), F.col("value")))
        low, high = value(F.floor(place)), value(F.ceil(place))
        return low + (high - low) * F.first(place - F.floor(place))

    named = zip(("min", "p25", "median", "p75", "max"), (0.0, 0.25, 0.5, 0.75, 1.0))
    return d.groupBy("feature").agg(F.first("n").alias("n"), *[at(p).alias(name) for name, p in named])


def quantiles(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, min, p25, median, p75, max), exact with linear interpolation, nulls and NaN left out.

    Equal values are counted first, in one pass over `df`; their counts are summed up in two levels, and the values at the
    wanted places read off.
    """
    return _quantiles(_value_counts(df, features))


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Quantiles with mean and sample standard deviation, from the same counts."""
    counts = _value_counts(df, features)
    sums = counts.groupBy("feature").agg(F.sum("m").alias("_n"), (F.sum(F.col("value") * F.col("m")) / F.sum("m")).alias("mean"))
    gap = F.col("value") - F.col("mean")
    spread = counts.join(F.broadcast(sums), "feature").groupBy("feature").agg(F.first("mean").alias("mean"), F.sqrt(F.try_divide(F.sum(gap * gap * F.col("m")), F.first("_n") - 1)).alias("std"))
    return _quantiles(counts).join(spread, "feature")


def equal_width_bins(df: DataFrame, value: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_label): right-closed bins of equal width; the least value belongs to the first."""
    edges = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.ceil(F.round((F.col(value) - F.col("_lo")) / F.when(width == 0, 1.0).otherwise(width), 9))
    binned = df.select(value, label).join(edges).withColumn("bin", F.greatest(F.least(at, F.lit(bins)), F.lit(1)).cast("int"))
    return binned.where(F.col(value).isNotNull()).groupBy("bin").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"))


def min_max(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """Features scaled to 0..1 by the column's range; the range is one row and broadcast."""
    ends = df.agg(*[F.min(f).cast("double").alias(f"_lo_{f}") for f in features], *[F.max(f).cast("double").alias(f"_hi_{f}") for f in features])
    return df.join(F.broadcast(ends)).select(*keep, *[scaled(F.col(f).cast("double"), F.col(f"_lo_{f}"), F.col(f"_hi_{f}")).alias(f) for f in features])
