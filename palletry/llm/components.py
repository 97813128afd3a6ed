"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palletry.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node of some edges (x, y), the root included.

    Nodes may be of any orderable type. Each round hangs a node's neighbours on the least of them, by an aggregation
    with map-side combining and a join that Spark may split, so a hub isn't one task; rounds grow with the logarithm
    of a component's size. Each round is a written table.
    """
    e = written(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x"), F.col("m").alias("y")))).alias("e"))
        e = written(small.select("e.*").where("x <> y").distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
