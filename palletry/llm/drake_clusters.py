"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Every vector carries the numbers of its nearest centroids, an upper bound of the distance to the first, a lower bound
of the distance to each other one named, and one remainder bound for all centroids that it doesn't name. When
centroids move, the bounds move with them, and a vector looks only at the named centroids whose bounds don't exceed
the upper one. Where even the remainder bound can't certify the order, all distances are computed anew. Bounds are
compared with a margin for rounding and strictly, so ties are always settled on exact integer distances. The number
of names starts at a quarter of the centroids and shrinks, down to an eighth, to what the last round needed.

A round is one pass over the rows, written as a table that replaces that of the round before, and one aggregation of
sums by centroid. Rows aren't shuffled. The driver holds `k` centroids. A vector's copies cost what other rows cost.

Defined results: vectors that are null, of another length or with null, NaN or infinite components take no part; with
fewer than `k` vectors each starts a centroid, copies included; an empty table gives an empty result. Of equal ids
(the null id counts as an empty text) the lesser vector comes first among the starts; rows with equal ids stay rows
of their own. Texts aren't looked at, nor are further columns. A component of 2**27 / `scale` or more is an error, as squared
distances wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palletry.llm.common import replaced, slices

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT, MARGIN = 1 << 27, 1e-9


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def floored(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * c) of each component; one beyond the limit is an error."""
    wide = lambda c: c.cast("double") * scale
    too_large = F.raise_error(F.concat(F.lit(f"component beyond {limit} / {scale}: "), vector.cast("string"))).cast("long")
    return F.transform(vector, lambda c: F.when(F.abs(wide(c)) < limit, F.floor(wide(c))).otherwise(too_large))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact, of rows to centroids."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


class Bounds:
    """The carried state of some rows: `near` (the assigned centroid, then those named), bounds, and the depth last looked at."""

    def __init__(self, near: np.ndarray, low: np.ndarray, upper: np.ndarray, rest: np.ndarray, depth: np.ndarray):
        self.near, self.low, self.upper, self.rest, self.depth = near, low, upper, rest, depth

    @staticmethod
    def scanned(x: np.ndarray, centroids: np.ndarray, names: int) -> Bounds:
        """Exact state from all distances; of equal ones the smaller number comes first."""
        d = distances(x, centroids)
        order = np.argsort(d, 1, kind="stable")[:, : names + 2]
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        rest = root[:, names + 1] if len(centroids) > names + 1 else np.full(len(x), np.inf)
        return Bounds(order[:, : names + 1], root[:, 1 : names + 1], root[:, 0], rest, np.full(len(x), -1))

    def narrowed(self, names: int) -> Bounds:
        """With fewer names; the others' bounds go into the remainder."""
        rest = np.minimum(self.rest, self.low[:, names:].min(1, initial=np.inf))
        return Bounds(self.near[:, : names + 1].copy(), self.low[:, :names].copy(), self.upper, rest, self.depth)

    def moved(self, x: np.ndarray, centroids: np.ndarray, by: np.ndarray, names: int) -> Bounds:
        """The state after each centroid moved `by` its distance: what the bounds certify stays, the rest is looked at."""
        s = self.narrowed(names)
        s.upper = s.upper + by[s.near[:, 0]]
        s.low = np.maximum(s.low - by[s.near[:, 1:]], 0)
        s.rest = np.maximum(s.rest - by.max(), 0)
        bounds = np.concatenate([s.low, s.rest[:, None]], 1)
        bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]  # of a name and all after it
        sure = (s.upper * (1 + MARGIN) + MARGIN)[:, None] < bounds * (1 - MARGIN)
        s.depth = np.where(sure.any(1), sure.argmax(1), -1)
        for z in np.unique(s.depth):
            rows = np.flatnonzero(s.depth == z)
            if z < 0:
                full = Bounds.scanned(x[rows], centroids, names)
                s.near[rows], s.low[rows], s.upper[rows], s.rest[rows] = full.near, full.low, full.upper, full.rest
            elif z > 0:
                some = np.sort(s.near[rows, : z + 1], 1)
                gap = x[rows][:, None, :] - centroids[some]
                d = (gap * gap).sum(2)
                order = np.argsort(d, 1, kind="stable")
                root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
                s.near[rows, : z + 1] = np.take_along_axis(some, order, 1)
                s.upper[rows], s.low[rows, :z] = root[:, 0], root[:, 1:]
        return s


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(len(column), -1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(a.reshape(-1), kind))


def _pass(centroids: np.ndarray, by: np.ndarray | None, names: int, last: bool):
    """A round's pass over (id, x[, near, low, upper, rest]); the last gives (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            x = _matrix(b.column(1), np.int64)
            if by is None:
                s = Bounds.scanned(x, centroids, names)
            else:
                near, low = _matrix(b.column(2), np.int64), _matrix(b.column(3), np.float64)
                s = Bounds(near, low, b.column(4).to_numpy(), b.column(5).to_numpy(), None).moved(x, centroids, by, names)
            if last:
                gap = x - centroids[s.near[:, 0]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.near[:, 0], pa.int32()), pa.array((gap * gap).sum(1))], ["id", "cluster", "distance"])
            else:
                parts = [b.column(0), b.column(1), _lists(s.near, pa.int32()), _lists(s.low, pa.float64()), pa.array(s.upper), pa.array(s.rest), pa.array(s.depth, pa.int32())]
                yield pa.RecordBatch.from_arrays(parts, ["id", "x", "near", "low", "upper", "rest", "depth"])

    return run


def clustered(
    df: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids): `rounds` rounds of assignment and update, then one more assignment."""
    v = F.col(vector_col)
    usable = df.where((F.size(v) == size) & finite(v))
    rows = usable.select(F.col(id_col).alias("id"), floored(v, scale, LIMIT).cast("array<int>").alias("x"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, size)
    kind = dict(rows.dtypes)["id"]
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    most = len(centroids) - 1
    names, least = min(max(1, k // 4), most), min(max(1, k // 8), most)
    state, by = None, None
    for _ in range(rounds):
        source = rows if state is None else state.select("id", "x", "near", "low", "upper", "rest")
        out = source.mapInArrow(_pass(centroids, by, names, False), f"id {kind}, x array<int>, near array<int>, low array<double>, upper double, rest double, depth int")
        state = replaced(out, "bounds", state)
        sums = state.groupBy(F.col("near")[0].alias("cluster")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.array(*[F.sum(F.col("x")[i].cast("long")) for i in range(size)]).alias("sums"))
        new, deepest = centroids.copy(), -1
        for r in sums.collect():  # at most k rows
            new[r.cluster] = [s // r.n for s in r.sums]
            deepest = max(deepest, r.depth)
        gap = (new - centroids).astype(np.float64)
        by, centroids = np.sqrt((gap * gap).sum(1)) * (1 + MARGIN), new
        if deepest >= 0:
            names = max(least, min(names, deepest))
    source = rows if state is None else state.select("id", "x", "near", "low", "upper", "rest")
    final = replaced(source.mapInArrow(_pass(centroids, by, names, True), f"id {kind}, cluster int, distance long"), "clusters", state)
    return final, centroids


def cluster_report(df: DataFrame, **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    rows, centroids = clustered(df, **options)
    by_cluster = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(i, by_cluster.get(i, 0), sum(by_cluster.values()), h) for i, h in enumerate(digest)]
    report = df.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(report), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
