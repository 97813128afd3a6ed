"""Stored tours, changed as tables: spliced paths, accepted candidates, edge deposits, and other forms of one solution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.functions.numeric import hash_fraction
from palletry.operators.geometry import tour_length
from palletry.sources.io import dealt


def spliced(tours: DataFrame, paths: DataFrame) -> DataFrame:
    """Tours (instance, pos, node) with some positions filled anew: `paths` has (instance, pos, pick), where `pick` counts from 0
    among the nodes at the path's positions, sorted. A path whose picks aren't a permutation fails the job.

    Only the paths' positions are ranked; the rest of a tour isn't sorted.
    """
    old = tours.join(paths, ["instance", "pos"])
    nth = F.row_number().over(Window.partitionBy("instance").orderBy("node")) - 1
    nodes = old.select("instance", nth.alias("pick"), F.col("node").alias("new"))
    placed = paths.join(nodes, ["instance", "pick"]).select("instance", "pos", "new")
    check = paths.groupBy("instance").agg(F.count_distinct("pick").alias("_k"), F.count("*").alias("_n"), F.max("pick").alias("_m"))
    wrong = check.where("_k <> _n or _m <> _n - 1").select("instance", F.lit(True).alias("_wrong"))
    out = tours.join(placed, ["instance", "pos"], "left").join(wrong, "instance", "left")
    node = F.when(F.col("_wrong"), F.raise_error(F.concat(F.lit("not a permutation: "), F.col("instance").cast("string"))).cast("long")).otherwise(F.coalesce("new", "node"))
    return out.select("instance", "pos", node.cast(tours.schema["node"].dataType).alias("node"))


def accepted(before: DataFrame, after: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tours, report): of each instance the candidate if it is shorter, else the tour it had; (instance, before, after, taken)."""
    length = lambda t, name: tour_length(t.join(places, ["instance", "node"])).withColumnRenamed("length", name)
    report = length(before, "before").join(length(after, "after"), "instance").withColumn("taken", F.col("after") < F.col("before"))
    both = before.withColumnRenamed("node", "_old").join(after.withColumnRenamed("node", "_new"), ["instance", "pos"]).join(report.select("instance", "taken"), "instance")
    return both.select("instance", "pos", F.when(F.col("taken"), F.col("_new")).otherwise(F.col("_old")).alias("node")), report


def deposited(state: DataFrame, tours: DataFrame, costs: DataFrame, decay: float = 0.9, level: float = 1.0) -> DataFrame:
    """(instance, u, v, value): levels of edges after one step of evaporation and deposit.

    All levels decay; each tour (instance, tour, pos, node) then adds 1 / cost to both directions of its edges, the closing one
    included. An edge that `state` doesn't have starts from `level`; those that neither has aren't listed.
    """
    order = Window.partitionBy("instance", "tour").orderBy("pos")
    first = F.first("node").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = tours.select("instance", "tour", F.col("node").alias("u"), F.coalesce(F.lead("node").over(order), first).alias("v"))
    edges = edges.unionByName(edges.select("instance", "tour", F.col("v").alias("u"), F.col("u").alias("v")))
    added = edges.join(costs.select("instance", "tour", "cost"), ["instance", "tour"]).groupBy("instance", "u", "v").agg(F.sum(1 / F.col("cost")).alias("_added"))
    both = state.select("instance", "u", "v", "value").join(added, ["instance", "u", "v"], "full")
    return both.select("instance", "u", "v", (F.coalesce("value", F.lit(level)) * decay + F.coalesce("_added", F.lit(0.0))).alias("value"))


def _segments(flagged: DataFrame) -> DataFrame:
    """`flagged` (instance, pos, node, from_depot; pos from 1) with its route's number, first and last position, and the solution's length."""
    order = Window.partitionBy("instance").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = flagged.withColumn("route", F.sum("from_depot").over(order))
    ends = r.groupBy("instance", "route").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    own = Window.partitionBy("instance")  # of a row a route
    ends = ends.withColumns({"n": F.max("last").over(own), "routes": F.count("*").over(own)})
    return r.join(ends, ["instance", "route"])


def _chance(seed: int, *keys: str) -> Column:
    return hash_fraction(*[F.col(k) for k in keys], seed=seed)


def inverted(flagged: DataFrame, seed: int = 1) -> DataFrame:
    """(instance, pos, node, from_depot): half of the routes turned round where they stand; routes keep their nodes."""
    s = _segments(flagged)
    turned = _chance(seed, "instance", "route") <= 0.5
    pos = F.when(turned, F.col("first") + F.col("last") - F.col("pos")).otherwise(F.col("pos"))
    return s.select("instance", pos.alias("pos"), "node", (pos == F.col("first")).cast("int").alias("from_depot"))


def shifted(flagged: DataFrame, seed: int = 1, turn: bool = True) -> DataFrame:
    """(instance, pos, node, from_depot): each solution starts with another of its routes, drawn from a seed, and the routes before it
    follow at the end; with `turn`, half of the solutions are turned round first, the last route becoming the first.

    Positions move by arithmetic modulo the solution's length; no solution is gathered.
    """
    s = _segments(flagged)
    whole = (_chance(seed, "instance") >= 0.5) & F.lit(turn)
    s = s.select(
        "instance", "node", "n", "routes",
        F.when(whole, F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"),
        F.when(whole, F.col("n") + 1 - F.col("last")).otherwise(F.col("first")).alias("first"),
        F.when(whole, F.col("routes") + 1 - F.col("route")).otherwise(F.col("route")).alias("route"),
    )
    head = F.floor(_chance(seed + 1, "instance") * F.col("routes")) + 1
    starts = s.where(F.col("route") == head).groupBy("instance").agg(F.first("first").alias("_start"))
    s = s.join(starts, "instance")
    pos = F.pmod(F.col("pos") - F.col("_start"), F.col("n")) + 1
    return s.select("instance", pos.alias("pos"), "node", (F.col("pos") == F.col("first")).cast("int").alias("from_depot"))


def route_capacity(n: Column) -> Column:
    """A vehicle's capacity for so many customers; null for other numbers."""
    return F.when(n == 10, 20.0).when(n == 20, 30.0).when(n == 50, 40.0).when(n == 100, 50.0).when(n == 200, 80.0).when(n == 500, 100.0).when(n == 1000, 250.0)


def replayed(steps: DataFrame, stops: DataFrame, capacity: float, depot: int | None = 0, slack: float = 1e-5, tasks: int | None = None) -> DataFrame:
    """Stored rollouts (instance, tour, pos, node) with the state that each step leaves: `load`, what the vehicle can still take;
    `seen`, the stops visited so far; `finished`; and `allowed`, whether the mask before the step let it through.

    `stops` has (instance, node, demand). The first step may go anywhere. Then a stop is allowed once, if its demand is at most the
    load plus `slack`; the depot, where the load is filled up, is allowed unless the vehicle stands there. A rollout that has seen all
    stops and stands at the depot is finished, and may only stay there. Without a depot (None) it is finished with its last stop, and
    nothing is allowed afterwards. Steps that break the mask count like others. A node that the instance lacks is never allowed and
    demands nothing; instances without stops are left out; rollouts may end early. `tasks` is their number, or else the session's.
    """
    stops = dealt(stops, tasks, "instance")
    number = stops.groupBy("instance").agg(F.count("*").alias("_n"))
    home = F.lit(False) if depot is None else F.col("node") == depot
    d = dealt(steps.select("instance", "tour", "pos", "node"), tasks, "instance", "node")
    d = dealt(d.join(dealt(stops.select("instance", "node", "demand"), tasks, "instance", "node"), ["instance", "node"], "left"), tasks, "instance").join(number, "instance")
    known = F.col("demand").isNotNull() & ~F.col("_home")
    order = Window.partitionBy("instance", "tour").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_home", home).withColumns({"_known": known, "_need": F.when(known, F.col("demand")).otherwise(0)})
    d = d.withColumn("_fresh", F.row_number().over(Window.partitionBy("instance", "tour", "node").orderBy("pos")) == 1)
    d = d.withColumns({"_used": F.sum("_need").over(upto), "seen": F.sum((F.col("_known") & F.col("_fresh")).cast("long")).over(upto)})
    filled = F.coalesce(F.last(F.when(F.col("_home"), F.col("_used")), ignorenulls=True).over(upto), F.lit(0))
    ends = (F.col("seen") == F.col("_n")) & (F.lit(depot is None) | F.col("_home"))
    d = d.withColumns({"load": F.lit(capacity) - F.col("_used") + filled, "finished": F.max(ends).over(upto)})
    before = lambda c: F.lag(c).over(order)
    allowed = (
        F.when(before("pos").isNull(), F.col("_known") | F.col("_home"))
        .when(before("finished"), F.col("_home"))
        .when(before("load") + slack < F.col("_need"), False)
        .when(F.col("_home"), ~before("_home"))
        .otherwise(F.col("_known") & F.col("_fresh"))
    )
    return d.withColumn("allowed", allowed).select("instance", "tour", "pos", "node", "load", "seen", "finished", "allowed")


def choices(steps: DataFrame, stops: DataFrame, capacity: float, depot: int | None = 0, slack: float = 1e-5) -> DataFrame:
    """(instance, tour, node, allowed): the mask over the depot and all stops after the last step of each stored rollout."""
    last = replayed(steps, stops, capacity, depot, slack).groupBy("instance", "tour").agg(F.max_by(F.struct("node", "load", "finished"), "pos").alias("_last"))
    visited = steps.select("instance", "tour", "node").distinct().withColumn("_visited", F.lit(True))
    places = stops.select("instance", "node", "demand")
    home = F.lit(False)
    if depot is not None:
        zero = lambda c: F.lit(depot if c == "node" else 0).cast(stops.schema[c].dataType).alias(c)
        home = F.col("node") == depot
        places = places.where(~home).unionByName(stops.select("instance").distinct().select("instance", zero("node"), zero("demand")))
    fits = F.col("_last.load") + slack >= F.col("demand")
    allowed = F.when(home, F.col("_last.finished") | (F.col("_last.node") != F.col("node")) & fits).otherwise(F.col("_visited").isNull() & fits)
    return last.join(places, "instance").join(visited, ["instance", "tour", "node"], "left").select("instance", "tour", "node", allowed.alias("allowed"))
