"""Instances of points: distances, neighbours, tours and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import hash_fraction
from palletry.sources.io import dealt


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def pairwise(nodes: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """(instance, u, v, d): the distance matrix of each instance, an equi-join on it."""
    a = nodes.select("instance", F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select("instance", F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    d = F.when(F.col("u") == F.col("v"), F.lit(diagonal)).otherwise(distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))
    return a.join(b, "instance").select("instance", "u", "v", d.alias("d"))


def nearest_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """The k nearest other nodes of each node, smaller ids first among equals."""
    d = pairwise(nodes).where("u <> v").withColumn("d", F.round("d", 9))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("instance", "u").orderBy("d", "v"))).where(F.col("rank") <= k)


def tour_length(tours: DataFrame) -> DataFrame:
    """(instance, length) of closed tours (instance, pos, x, y)."""
    own = Window.partitionBy("instance")
    order = own.orderBy("pos")
    following = lambda k: F.coalesce(F.lead(k).over(order), F.first(k).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edges = tours.select("instance", distance(F.col("x"), F.col("y"), following("x"), following("y")).alias("d"))
    return edges.groupBy("instance").agg(F.sum("d").alias("length"))


def augmented(nodes: DataFrame) -> DataFrame:
    """(instance, node, turn, x, y): the eight symmetries of the unit square."""
    x, y = F.col("x"), F.col("y")
    forms = [(x, y), (1 - x, y), (x, 1 - y), (1 - x, 1 - y), (y, x), (1 - y, x), (y, 1 - x), (1 - y, 1 - x)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), a.alias("x"), b.alias("y")) for i, (a, b) in enumerate(forms)]))
    return nodes.select("instance", "node", each.alias("p")).select("instance", "node", "p.*")


def prizes(nodes: DataFrame) -> DataFrame:
    """`nodes` with `prize`: (1 + floor(99 d / max d)) / 100 by distance from node 0, over the instance's greatest prize."""
    own = Window.partitionBy("instance")
    base = lambda k: F.first(F.when(F.col("nth") == 1, F.col(k)), ignorenulls=True).over(own)
    d = nodes.withColumn("nth", F.row_number().over(own.orderBy("node")))
    d = d.withColumn("d", distance(F.col("x"), F.col("y"), base("x"), base("y")))
    d = d.withColumn("raw", 1 + F.floor(F.round(99 * F.col("d") / F.max("d").over(own), 9)))
    return d.withColumn("prize", F.col("raw") / F.max("raw").over(own)).drop("nth", "d", "raw")


def max_length(n: Column) -> Column:
    """The tour length allowed for an orienteering instance of n nodes."""
    return F.when(n <= 50, 3.0).when(n <= 100, 4.0).when(n <= 200, 5.0).when(n <= 300, 6.0).otherwise(7.0)


def depot_flags(tour: DataFrame, tasks: int | None = None) -> DataFrame:
    """(instance, pos, node, from_depot): the two-row form of tours that visit node 0 between routes; `tasks` is their number, or else the session's."""
    order = Window.partitionBy("instance").orderBy("pos")
    t = dealt(tour, tasks, "instance").withColumn("from_depot", (F.lag("node").over(order) == 0).cast("int")).where("node <> 0")
    return t.select("instance", F.row_number().over(order).alias("pos"), "node", F.coalesce("from_depot", F.lit(1)).alias("from_depot"))


def routes(flagged: DataFrame, demand: DataFrame, capacity: float, tasks: int | None = None) -> DataFrame:
    """(instance, route, n_nodes, load, legal): routes of a two-row solution with their loads; `tasks` as above."""
    order = Window.partitionBy("instance").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = dealt(flagged.withColumn("route", F.sum("from_depot").over(order)), tasks, "instance", "node")
    r = dealt(r.join(dealt(demand, tasks, "instance", "node"), ["instance", "node"]), tasks, "instance")
    return r.groupBy("instance", "route").agg(F.count("*").alias("n_nodes"), F.sum("demand").alias("load")).withColumn("legal", F.col("load") <= capacity)


def reversed_routes(flagged: DataFrame, seed: int = 1) -> DataFrame:
    """(instance, route, nodes): each route's nodes in order, half of the routes turned round."""
    order = Window.partitionBy("instance").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = flagged.withColumn("route", F.sum("from_depot").over(order)).groupBy("instance", "route").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("n"))
    nodes = F.transform("n", lambda x: x["node"])
    return r.select("instance", "route", F.when(hash_fraction(F.col("instance"), F.col("route"), seed=seed) < 0.5, F.reverse(nodes)).otherwise(nodes).alias("nodes"))


def gaps(results: DataFrame, optima: DataFrame) -> DataFrame:
    """(instance, mean, std, gap_pct) of lengths over starts against known optima; population deviation."""
    m = results.groupBy("instance").agg(F.avg("length").alias("mean"), F.stddev_pop("length").alias("std"))
    return m.join(optima, "instance").withColumn("gap_pct", 100 * (F.col("mean") / F.col("optimum") - 1))


def best_of_starts(rewards: DataFrame) -> DataFrame:
    """One row: mean over instances of the best reward over augmentations and starts."""
    best = rewards.groupBy("instance").agg(F.max("reward").alias("best"))
    return best.agg(F.avg("best").alias("mean_best"), F.count("*").alias("n"))


def random_nodes(spark, instances: int, nodes: int, seed: int = 1234) -> DataFrame:
    """Seeded uniform instances (instance, node, x, y)."""
    t = spark.range(instances * nodes).select((F.col("id") / nodes).cast("long").alias("instance"), (F.col("id") % nodes).alias("node"))
    u = lambda axis: hash_fraction(F.col("instance"), F.col("node"), F.lit(axis), seed=seed)
    return t.withColumns({"x": u("x"), "y": u("y")})
