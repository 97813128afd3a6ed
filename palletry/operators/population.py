"""Populations of rules or individuals: islands, selection weights, diversity, sampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import hash_fraction

CUTS = 64


def range_of(df: DataFrame, column: str) -> Column:
    """The number of a row's range among those that `CUTS` quantiles of a numeric column bound; -1 for null."""
    cuts = sorted(set(df.approxQuantile(column, [i / CUTS for i in range(1, CUTS)], 0.5 / CUTS)))
    at = F.col(column)
    return F.when(at.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at))) if cuts else F.lit(0)


def running(df: DataFrame, column: str, value: str, order: str, by: list[str], fold: Callable[[str], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """`df` with `column`, a fold of the values so far in each group; `order` is a number.

    Folds have two levels, so that no group lies in one task: ranges of the order are folded apart, and each starts from
    the fold of the ranges before it.
    """
    d = df.withColumn("_part", range_of(df, order))
    inner = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # of at most CUTS + 1 rows a group
    base = d.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_at")).agg(fold(value).alias("_all")).withColumn("_base", fold("_all").over(ahead))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_at"))
    d = d.withColumn("_own", fold(value).over(inner)).join(base, same)
    return d.withColumn(column, join(F.col("_own"), F.col("_base"))).select(*df.columns, column)


def round_robin(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """`df` with `island`: rows in order go to the islands in turn; the first column of the order is a number.

    Ranks have two levels: `CUTS` quantiles of that column bound the ranges that are ranked apart, nulls first.
    """
    d = df.withColumn("_part", range_of(df, order[0]))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of at most CUTS + 1 rows
    base = d.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return d.withColumn("_nth", nth).join(F.broadcast(base), "_part").withColumn("island", ((F.col("_nth") + F.col("_base")) % n).cast("int")).drop("_part", "_nth", "_base")


def ranked_within(df: DataFrame, by: list[str], order: str, *ties: str) -> DataFrame:
    """`df` with `rank` (from 1, the greatest `order` first, then `ties` rising, nulls last) and `group_size`.

    Two levels, so that no group is one task: ranges of the order are ranked apart after their counts are summed up.
    """
    d = df.withColumn("_down", F.coalesce(-F.col(order).cast("double"), F.lit(float("inf"))))
    d = d.withColumn("_part", range_of(d, "_down"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    base = d.groupBy(*keys, F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*names)  # of at most CUTS + 1 rows
    base = base.select(*names, "_at", F.coalesce(F.sum("_n").over(own.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(own).alias("group_size"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)], F.col("_part") == F.col("_at"))
    nth = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_down", *ties))
    return d.withColumn("_nth", nth).join(base, same).withColumn("rank", F.col("_ahead") + F.col("_nth")).select(*df.columns, "rank", "group_size")


def survivors(df: DataFrame, reward: str, order: str, by: list[str], elite_rate: float = 0.2) -> DataFrame:
    """The better half of each population, of rewards and ties as ranked, with `rank` and `elite`.

    Of p members the floor(p / 2) last ones go. The floor(p * elite_rate) first ones are elites, which the next population takes
    over as they are; those beyond the better half are kept too.
    """
    d = ranked_within(df, by, reward, order)
    elite = F.col("rank") <= F.floor(F.col("group_size") * elite_rate + 1e-9)
    return d.withColumn("elite", elite).where(F.col("elite") | (F.col("rank") <= F.col("group_size") - F.floor(F.col("group_size") / 2))).drop("group_size")


def next_population(kept: DataFrame, children: DataFrame, order: str, by: list[str], size: int) -> DataFrame:
    """Each population's elites, then its children in order until there are `size` members; `origin` tells which."""
    elites = kept.where("elite").select(*children.columns, F.lit("elite").alias("origin"))
    room = kept.groupBy(*by).agg(F.sum(F.col("elite").cast("int")).alias("_elites"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    born = children.withColumn("_nth", nth).join(room, by, "left").where(F.col("_nth") <= size - F.coalesce("_elites", F.lit(0)))
    return elites.unionByName(born.select(*children.columns, F.lit("child").alias("origin")))


def drawn_parents(df: DataFrame, order: list[Column | str], key: str, by: list[str], draws: int, m: int, seed: int = 2024) -> DataFrame:
    """(by, draw, nth, key): m parents with replacement for each of so many draws in every population.

    Chances are 1 / (rank + 1 + p) among p members ranked by `order`. Members own intervals of their cumulated chances; seeded
    uniform numbers, one a draw and parent, meet the interval they fall into. Populations have tens of members.
    """
    w = rank_weights(df, order, by=by)
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumns({"_high": F.sum("probability").over(upto), "_last": F.max("rank").over(Window.partitionBy(*by)) == F.col("rank")})
    w = w.withColumn("_low", F.col("_high") - F.col("probability"))
    each = F.explode(F.sequence(F.lit(0), F.lit(draws * m - 1)))
    u = df.select(*by).distinct().select(*by, each.alias("_i"))
    u = u.select(*[F.col(c).alias(f"_{c}") for c in by], "_i", hash_fraction(*[F.col(c) for c in by], F.col("_i"), seed=seed).alias("_u"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    hit = (F.col("_u") >= F.col("_low")) & ((F.col("_u") < F.col("_high")) | F.col("_last"))
    return w.join(u, same & hit).select(*by, F.floor(F.col("_i") / m).alias("draw"), (F.col("_i") % m).alias("nth"), key)


def top_per_island(df: DataFrame, order: list[Column | str], keep: int, island: str = "island") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(island).orderBy(*order))).where(F.col("rank") <= keep)


def rank_weights(df: DataFrame, order: list[Column | str], offset: bool = True, by: list[str] | None = None) -> DataFrame:
    """`df` with rank (from 0) and probability 1/(rank + 1 + n), or 1/(rank + 1) without offset, normalised in each
    population that `by` names; without it all rows are one, which then has to be small."""
    everything = Window.partitionBy(*(by or []))
    d = df.withColumns({"rank": F.row_number().over(everything.orderBy(*order)) - 1, "_n": F.count("*").over(everything)})
    d = d.withColumn("_w", 1.0 / (F.col("rank") + 1 + (F.col("_n") if offset else 0)))
    return d.withColumn("probability", F.col("_w") / F.sum("_w").over(everything)).drop("_n", "_w")


def boltzmann(df: DataFrame, score: str, temperature: float, island: str = "island") -> DataFrame:
    """`df` with probability exp(score/T) normalised in each island."""
    w = F.exp(F.col(score) / temperature)
    total = df.groupBy(F.col(island).alias("_island")).agg(F.sum(w).alias("_total"))
    d = df.join(F.broadcast(total), F.col(island).eqNullSafe(F.col("_island")))
    return d.withColumn("probability", w / F.col("_total")).drop("_island", "_total")


def byte_set(code: Column) -> Column:
    return F.array_distinct(F.filter(F.split(code, ""), lambda c: c != ""))


def pair_diversity(df: DataFrame, id_col: str, code: str, by: list[str] | None = None) -> DataFrame:
    """(a, b, distance) of all unordered pairs of a population: one minus the Jaccard similarity of their characters.

    `by` names the populations, of tens of members each; without it all rows are one.
    """
    s = df.select(F.struct(*(by or [F.lit(0)])).alias("p"), F.col(id_col).alias("id"), byte_set(F.col(code)).alias("s"))
    a, b = s.select("p", F.col("id").alias("a"), F.col("s").alias("sa")), s.select("p", F.col("id").alias("b"), F.col("s").alias("sb"))
    pairs = a.join(b, "p").where("a < b")
    both, either = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return pairs.select("a", "b", (1 - F.coalesce(F.try_divide(both, either), F.lit(0.0))).alias("distance"))


def unique_smallest(df: DataFrame, objective: str, order: str, n: int) -> DataFrame:
    """The n least distinct objectives, each with its first individual; null and infinite ones don't count."""
    d = df.where(F.col(objective).isNotNull() & (F.col(objective) < float("inf")))
    first = d.withColumn("_nth", F.row_number().over(Window.partitionBy(objective).orderBy(order))).where("_nth = 1").drop("_nth")
    return first.orderBy(objective, order).limit(n)


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, with chances in proportion to a weight: the least of exponential keys."""
    u = F.greatest(hash_fraction(F.col(key), seed=seed), F.lit(1e-12))
    return df.where(F.col(weight) > 0).withColumn("_key", F.round(-F.ln(u) / F.col(weight), 9)).orderBy("_key", key).limit(n).drop("_key")


def running_best(df: DataFrame, iteration: str, score: str, *by: str) -> DataFrame:
    """`df` with `best`, the greatest score so far."""
    return running(df, "best", score, iteration, list(by), F.max, F.greatest)


def running_total(df: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """`df` with `total`, the sum so far."""
    return running(df, "total", value, order, list(by), F.sum, lambda a, b: F.coalesce(a + b, a, b))


def best_and_worst(df: DataFrame, score: str, island: str = "island") -> DataFrame:
    """One row: islands of the greatest and least top score, the first among equals."""
    tops = df.groupBy(island).agg(F.max(score).alias("top"))
    return tops.agg(F.max_by(island, F.struct("top", -F.col(island))).alias("best"), F.min_by(island, F.struct("top", island)).alias("worst"))


def elitist(df: DataFrame, objective: str, order: str) -> DataFrame:
    """The individual of least objective, the first among equals."""
    return df.orderBy(F.col(objective).asc_nulls_last(), order).limit(1)


def repeated_genes(df: DataFrame, individual: str, gene: str, position: str) -> DataFrame:
    """`df` with `repeated`: whether the gene stood earlier in its individual."""
    nth = F.row_number().over(Window.partitionBy(individual, gene).orderBy(position))
    return df.withColumn("repeated", nth > 1)


def best_rules_first(order: str) -> list[Column]:
    """Score, then corrections, then few overrides, then order of entry."""
    return [F.desc("score"), F.desc(F.col("fn_corr") + F.col("fp_corr")), F.asc("easy_overrides"), F.asc(order)]


def rebuilt(rules: DataFrame, order: str, islands: int = 4, size: int = 50) -> DataFrame:
    """Stored rules back on their islands, invalid island ids on the first, each island with its best `size` rules."""
    at = F.col("island_id")
    r = rules.withColumn("island_id", F.when(at.between(0, islands - 1), at).otherwise(0).cast("int"))
    return top_per_island(r, best_rules_first(order), size, "island_id").drop("rank")


def reset_worst(rules: DataFrame, id_col: str, order: str, islands: int = 4, keep: int = 3, clear: bool = False) -> DataFrame:
    """`rules` after the island of the least best score is cut to its top `keep` rules (one at least; none if `clear`) and given a copy of
    the best rule of the best island, whose id gets `_reset_` and four digits. An island without rules scores 0; the first
    among equals is taken; fewer than two islands stay as they are."""
    if islands < 2:
        return rules
    score = F.greatest(F.max("score"), F.lit(0.0)).alias("score")  # a best score starts from 0
    tops = rules.sparkSession.range(islands).select(F.col("id").cast("int").alias("island_id"), F.lit(0.0).alias("score"))
    tops = tops.unionByName(rules.select("island_id", "score")).groupBy("island_id").agg(score)
    ends = best_and_worst(tops.withColumnRenamed("island_id", "island"), "score")
    r = rules.withColumn("_rank", F.row_number().over(Window.partitionBy("island_id").orderBy(*best_rules_first(order))))
    r = r.crossJoin(F.broadcast(ends))  # one row
    here, donor = F.col("island_id") == F.col("worst"), (F.col("island_id") == F.col("best")) & (F.col("_rank") == 1)
    digits = F.format_string("%04d", F.floor(hash_fraction(F.col(id_col)) * 9000 + 1000).cast("int"))
    copy = r.where(donor).withColumns({id_col: F.concat(F.col(id_col).cast("string"), F.lit("_reset_"), digits), "island_id": F.col("worst").cast("int")})
    left = r.where(~here | (F.lit(not clear) & (F.col("_rank") <= max(1, keep)))).withColumn(id_col, F.col(id_col).cast("string"))
    return left.unionByName(copy).select(*rules.columns)


def valid(df: DataFrame, objective: str, ok: str = "exec_success", below: float | None = None) -> DataFrame:
    """Individuals that ran and, for a black box, are better than the seed's objective `below`."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return df.where(good if below is None else good & (F.col(objective) < below))


def joined_by(population: DataFrame, offspring: DataFrame, code: str, objective: str, order: str, digits: int = 5, repeats: bool = False) -> DataFrame:
    """A population and its new members: offspring whose code and rounded objective it doesn't have, the first of each
    objective; objectives are rounded to `digits`. With `repeats` all offspring join, also those of an objective that is
    there already, which `repeated` then marks."""
    p, o = (d.withColumn(objective, F.round(objective, digits)) for d in (population, offspring))
    if repeats:
        there = p.select(objective).distinct().withColumn("_there", F.lit(True))
        first = F.row_number().over(Window.partitionBy(objective).orderBy(order))
        o = o.withColumn("_nth", first).join(there, objective, "left")
        o = o.withColumn("repeated", F.coalesce("_there", F.lit(False)) | (F.col("_nth") > 1) & F.col(objective).isNotNull())
        return p.withColumn("repeated", F.lit(False)).unionByName(o.select(*p.columns, "repeated"))
    o = o.join(p.select(code).distinct(), code, "left_anti").join(p.select(objective).distinct(), objective, "left_anti")
    first = F.row_number().over(Window.partitionBy(objective).orderBy(order))
    return p.unionByName(o.withColumn("_nth", first).where("_nth = 1").drop("_nth"))


def setting_conflicts(before: DataFrame, now: DataFrame, hard: list[str], soft: list[str] | None = None) -> DataFrame:
    """(key, before, now, severity) of stored settings that a resumed run changes: `hard` ones are errors, `soft` ones (all
    others if None) warnings. A setting that wasn't stored, or a hard one that isn't given now, is no conflict."""
    d = changed_settings(before, now).where("before is not null")
    is_hard = F.col("key").isin(*hard)
    d = d.where(~is_hard | F.col("now").isNotNull())
    d = d if soft is None else d.where(is_hard | F.col("key").isin(*soft))
    return d.withColumn("severity", F.when(is_hard, "error").otherwise("warning"))


def accepted_settings(conflicts: DataFrame) -> DataFrame:
    """The warnings among conflicts; an error fails the job."""
    text = F.concat_ws(" ", F.col("key"), F.lit("does not match checkpoint"), F.col("before"))
    return conflicts.withColumn("key", F.when(F.col("severity") == "error", F.raise_error(text).cast("string")).otherwise(F.col("key")))


def changed_settings(before: DataFrame, now: DataFrame) -> DataFrame:
    """(key, before, now) of settings (key, value) that differ, absent ones null; two numbers are compared as numbers."""
    a, b = before.select("key", F.col("value").alias("before")), now.select("key", F.col("value").alias("now"))
    x, y = (F.col(c).cast("string").try_cast("double") for c in ("before", "now"))
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.col("before").eqNullSafe(F.col("now")))
    return a.join(b, "key", "full").where(~same)
