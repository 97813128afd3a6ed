"""Forests as node tables: rows walk down, by joins if the table is large, leaves are tokens with stored statistics, later rows look them up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palletry.sources.snapshots import shared_dir, stored

#: A node is some 50 bytes; larger tables of nodes are joined by a shuffle.
BROADCAST_NODES = 2_000_000
#: Up to so many inner nodes go to the tasks as arrays, in which a row walks down all trees at once.
WALKED_NODES = 200_000
NODES = ["tree", "node", "left", "right", "feature", "threshold", "impurity"]


def node_table(model, spark) -> DataFrame:
    """(tree, node, left, right, feature, threshold, impurity) of a fitted Spark ML forest over numbers; leaves have nulls.

    A row goes left if its feature is at most the threshold; the root is node 0.
    """
    path = f"{shared_dir(spark)}/palletry/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = lambda c: F.when(F.col("leftChild") >= 0, c)
    return n.select(
        "tree", F.col("id").alias("node"), inner(F.col("leftChild")).alias("left"), inner(F.col("rightChild")).alias("right"),
        inner(F.col("split.featureIndex")).alias("feature"), inner(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), "impurity",
    )


def with_depth(nodes: DataFrame) -> DataFrame:
    """A stored node table with `depth` of each node and `max_depth` of its tree, climbing from all nodes a level at a time."""
    nodes = stored(nodes.select(*NODES), "nodes")
    hint = _hint(nodes)
    child = lambda side: nodes.where(F.col(side).isNotNull()).select(F.col("tree"), F.col(side).alias("_at"), F.col("node").alias("_up"))
    up = hint(child("left").unionByName(child("right")))
    climbing = nodes.select("tree", "node", F.col("node").alias("_at"), F.lit(0).alias("depth"))
    while True:
        climbing = climbing.join(up, ["tree", "_at"], "left").select("tree", "node", F.coalesce("_up", F.lit(-1)).alias("_at"), (F.col("depth") + F.col("_up").isNotNull().cast("int")).alias("depth"))
        climbing = stored(climbing, "depths")
        if climbing.where("_at >= 0").isEmpty():
            break
    deepest = F.max("depth").over(Window.partitionBy("tree"))
    return stored(nodes.join(climbing.select("tree", "node", "depth"), ["tree", "node"]).withColumn("max_depth", deepest), "nodes")


def _hint(nodes: DataFrame):
    return F.broadcast if nodes.count() <= BROADCAST_NODES else lambda d: d


class _Walk:
    """Inner nodes as flat arrays by position. A leaf, or a child that has no row, points to itself."""

    def __init__(self, inner: pa.Table, trees: int):
        tree, node, left, right, self.feature = (inner.column(c).to_numpy().astype(np.int64) for c in ("tree", "node", "left", "right", "feature"))
        all_trees, key = np.concatenate([np.arange(trees), tree, tree, tree]), lambda t, n: t * (1 << 32) + n
        ends = np.unique(key(all_trees, np.concatenate([np.zeros(trees, np.int64), node, left, right])))
        at = np.searchsorted(ends, key(tree, node))
        self.node, self.root = ends % (1 << 32), np.searchsorted(ends, key(np.arange(trees), 0))
        feature, self.width = np.zeros(len(ends), np.int64), int(self.feature.max(initial=0)) + 1
        self.threshold, self.left, self.right = np.full(len(ends), np.inf), np.arange(len(ends)), np.arange(len(ends))
        feature[at], self.threshold[at] = self.feature, inner.column("threshold").to_numpy()
        self.left[at], self.right[at] = np.searchsorted(ends, key(tree, left)), np.searchsorted(ends, key(tree, right))
        self.feature = feature

    @staticmethod
    def fits(inner: pa.Table) -> bool:
        """Whether ids and thresholds are plain; joins serve others."""
        if any(inner.column(c).null_count for c in inner.column_names) or np.isnan(inner.column("threshold").to_numpy()).any():
            return False
        numbers = [inner.column(c).to_numpy() for c in ("tree", "node", "left", "right", "feature")]
        once = len(np.unique(np.stack(numbers[:2], 1), axis=0)) == inner.num_rows
        return once and all(((0 <= n) & (n < 1 << 31)).all() for n in numbers)

    def leaves(self, x: np.ndarray, levels: int) -> np.ndarray:
        """(rows, trees): the leaf of each row of a matrix; NaN goes right."""
        at, row = np.broadcast_to(self.root, (len(x), len(self.root))), np.arange(len(x))[:, None]
        for _ in range(levels):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.node[at]


def leaves(rows: DataFrame, nodes: DataFrame, row: str, x: str = "x", *keep: str) -> DataFrame:
    """(row, keep, tree, node): the leaf of each row in each tree; `nodes` has depths. A null or NaN feature goes right.

    Spark doesn't push filters of the result to `rows`, so filter these.
    """
    size = nodes.agg((F.max("tree") + 1).alias("trees"), F.max("depth").alias("levels"), F.count("left").alias("inner")).first()
    inner = nodes.where("left is not null").select("tree", "node", "left", "right", "feature", F.col("threshold").cast("double").alias("threshold"))
    if not size.trees:
        return rows.select(row, *keep, F.lit(0).alias("tree"), F.lit(0).alias("node")).where("false")
    if size.inner <= WALKED_NODES and _Walk.fits(found := inner.toArrow()):
        return _walked(rows, _Walk(found, size.trees), size.levels, dict(nodes.dtypes)["left"], row, x, *keep)
    inner = _hint(nodes)(inner)
    at = rows.select(row, *keep, F.col(x).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(size.trees - 1))).alias("tree")).withColumn("node", F.lit(0))
    for _ in range(size.levels):
        value = F.get("_x", F.col("feature"))
        below = F.when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(inner, ["tree", "node"], "left").select(row, *keep, "_x", "tree", F.when(F.col("left").isNull(), F.col("node")).otherwise(below).alias("node"))
    return at.select(row, *keep, "tree", "node")


def _walked(rows: DataFrame, walk: _Walk, levels: int, kind: str, row: str, x: str, *keep: str) -> DataFrame:
    shipped, width = rows.sparkSession.sparkContext.broadcast(walk), walk.width
    names = [row, *keep]
    entries = F.array(*[F.coalesce(F.get(x, F.lit(i)).cast("double"), F.lit(float("nan"))) for i in range(width)])
    rows = rows.select(*names, entries.alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = shipped.value.leaves(b.column(len(names)).flatten().to_numpy().reshape(b.num_rows, width), levels)
                ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))], [*names, "_nodes"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _nodes array<long>")
    out = out.select(*names, F.posexplode("_nodes").alias("tree", "node"))
    return out.withColumn("node", F.col("node").cast("long" if kind == "bigint" else "int"))


def vocabulary(known: DataFrame, nodes: DataFrame, label: str = "label") -> DataFrame:
    """(token, tree, node, pos_rate, log_count, depth_norm, impurity) of the leaves that `known` rows reach, stored.

    A tree's tokens start with its unknown one (node null), which has the share of all rows and no count, depth or impurity, and
    go on with its leaves in order. Shares are kept off 0 and 1; depth is relative to the tree's greatest.
    """
    share = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-4)), F.lit(1e-4))
    found = stored(known.groupBy("tree", "node").agg(F.avg(label).alias("p"), F.count("*").alias("n")), "leaves")
    all_rows = found.groupBy("tree").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p"), F.count("*").alias("size"))  # a row a tree
    start = F.coalesce(F.sum(F.col("size") + 1).over(Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = all_rows.withColumn("start", start)
    none = starts.select(F.col("start").alias("token"), "tree", F.lit(None).cast("int").alias("node"), share.alias("pos_rate"), *[F.lit(0.0).alias(c) for c in ("log_count", "depth_norm", "impurity")])
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("node"))
    own = found.withColumn("nth", nth).join(starts.select("tree", "start"), "tree").join(nodes.select("tree", "node", "depth", "max_depth", "impurity"), ["tree", "node"])
    own = own.select((F.col("start") + F.col("nth")).alias("token"), "tree", "node", share.alias("pos_rate"), F.log1p("n").alias("log_count"), (F.col("depth") / F.greatest("max_depth", F.lit(1))).alias("depth_norm"), "impurity")
    return stored(own.unionByName(none), "vocabulary")


def tokens(reached: DataFrame, words: DataFrame) -> DataFrame:
    """`reached` leaves with `token`: that of the leaf, or its tree's unknown one."""
    hint = _hint(words)
    known = words.where("node is not null").select("tree", "node", "token")
    unknown = words.where("node is null").select("tree", F.col("token").alias("_unknown"))
    return reached.join(hint(known), ["tree", "node"], "left").join(F.broadcast(unknown), "tree").withColumn("token", F.coalesce("token", "_unknown")).drop("_unknown")  # a row a tree


def looked_up(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` with the stored statistics of their tokens; a token that isn't stored has none."""
    return rows.join(_hint(words)(words.select("token", "pos_rate", "log_count", "depth_norm", "impurity")), "token", "left")
