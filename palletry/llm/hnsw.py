"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, flat neighbour arrays.

Equal vectors are one point of a graph, with the smallest ids that carry it (k+1 of them: ties go to smaller ids, so
no others can appear among k). Points are dealt to shards of about `SHARD_POINTS` by a hash. Each shard's graph is
built by one task and stored as a row of flat arrays. Up to `GROUP` graphs form a group: a task reads its group's graphs
once, then query vectors stream past them, and of each query only the best of the group leave the task. So a query is
sent once a group, not once a shard, and a graph is sent to as many tasks as small tables need to use a few cores
(`COPIES` at most). Scores are inner products of the original vectors in double precision.

Inside a shard the inner product becomes a distance: one more component gives all points the same length. Points enter
in batches, upper levels first; a batch finds its candidates in the graph so far and among itself.

Defined results: vectors that are null, zero or hold null, NaN or infinite components take no part, nor do rows without
id; vectors of different lengths never meet; repeated (id, vector) rows count once; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palletry.llm.common import mixed, written

SHARD_POINTS, GROUP, COPIES = 8192, 16, 8
DEGREE, BUILD_WIDTH, SEARCH_WIDTH, EXPAND = 24, 96, 200, 4


def searched(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries in one layer: (ids, similarities), best first, padded with len(points).

    `links` has a row of neighbours for each point, padded with len(points), and one more row of padding. Each round
    expands the best `EXPAND` points not yet expanded of every query that has some.
    """
    n, q = len(points), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids = np.full((q, width), n, np.int32)
    sims = np.full((q, width), -np.inf, np.float32)
    done = np.ones((q, width), bool)
    k = min(entry.shape[1], width)
    ids[:, :k] = entry[:, :k]
    real = ids[:, :k] < n
    sims[:, :k] = np.where(real, np.matmul(points[np.minimum(ids[:, :k], n - 1)], queries[:, :, None])[:, :, 0], -np.inf)
    done[:, :k] = ~real
    np.put_along_axis(seen, ids[:, :k].astype(np.int64), True, 1)
    live = np.arange(q)
    while True:
        live = live[~done[live].all(1)]
        if not len(live):
            return ids, sims
        at = np.argsort(done[live], 1, kind="stable")[:, :EXPAND]
        chosen = np.where(done[live[:, None], at], n, ids[live[:, None], at])
        done[live[:, None], at] = True
        near = links[chosen].reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], n, near)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = int((near < n).sum(1).max())
        if not fresh:
            continue
        near = np.sort(near, 1)[:, :fresh]
        seen[live[:, None], near] = True
        value = np.matmul(points[np.minimum(near, n - 1)], queries[live][:, :, None])[:, :, 0]
        value[near == n] = -np.inf
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], value], 1)
        all_done = np.concatenate([done[live], near == n], 1)
        best = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)


def diverse(points: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Neighbour choice: a candidate nearer to a chosen neighbour than to the point waits; waiting ones fill up."""
    n = len(points)
    if short := max(0, degree - near.shape[1]):
        near, sims = np.pad(near, ((0, 0), (0, short)), constant_values=n), np.pad(sims, ((0, 0), (0, short)), constant_values=-np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    v = points[np.minimum(near, n - 1)]
    mutual = np.matmul(v, v.transpose(0, 2, 1))
    valid = (near < n) & (near != own[:, None])
    chosen = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        covered = (chosen & (mutual[:, :, j] > sims[:, j, None])).any(1)
        chosen[:, j] = valid[:, j] & ~covered & (chosen.sum(1) < degree)
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    take = np.argsort(rank, 1, kind="stable")[:, :degree]
    return np.where(np.take_along_axis(rank, take, 1) == 2, n, np.take_along_axis(near, take, 1))


def linked(points: np.ndarray, members: np.ndarray, degree: int, width: int) -> np.ndarray:
    """One layer's neighbour array over `members`, built by inserting them in batches."""
    n = len(points)
    links = np.full((n + 1, degree), n, np.int32)
    inside, entry = 0, members[:1]
    while inside < len(members):
        batch = members[inside : inside + min(512, max(32, inside // 2))]
        own = points[batch]
        mutual = own @ own.T
        m = min(len(batch), degree)
        peers = np.argpartition(-mutual, m - 1, 1)[:, :m] if len(batch) > m else np.tile(np.arange(len(batch)), (len(batch), 1))
        near, sims = batch[peers].astype(np.int32), np.take_along_axis(mutual, peers, 1)
        if inside:
            found, value = searched(points, links, own, np.tile(entry, (len(batch), 1)), width)
            near, sims = np.concatenate([near, found], 1), np.concatenate([sims, value], 1)
        links[batch] = diverse(points, batch, near, sims, degree)
        source = np.repeat(batch, degree)
        target = links[batch].ravel()
        source, target = source[target < n], target[target < n]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hosts, start, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(hosts), int(count.max(initial=0))), n, np.int32)
        extra[np.repeat(np.arange(len(hosts)), count), np.arange(len(target)) - np.repeat(start, count)] = source
        for i in range(0, len(hosts), 256):
            h = hosts[i : i + 256]
            both = np.sort(np.concatenate([links[h], extra[i : i + 256]], 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = n
            value = np.matmul(points[np.minimum(both, n - 1)], points[h][:, :, None])[:, :, 0]
            value[both == n] = -np.inf
            keep = np.argsort(-value, 1, kind="stable")[:, : 2 * degree]
            links[h] = diverse(points, h, np.take_along_axis(both, keep, 1), np.take_along_axis(value, keep, 1), degree)
        inside += len(batch)
    return links


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Points of one length whose inner products with (query, 0) are those of the vectors."""
    square = (vectors**2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


class Graph:
    """Layers from the top (few points) to the bottom (all): members and links of each."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.points = lifted(vectors)
        n = len(vectors)
        u = (mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(np.maximum(u, 1e-300)) / math.log(DEGREE)).astype(int)
        level[0] = level.max()
        self.members = [np.flatnonzero(level >= k) for k in range(int(level.max()), -1, -1)]
        self.members = [np.r_[0, m[m != 0]] for m in self.members]
        self.layers = layers or [linked(self.points, m, 2 * DEGREE if len(m) == n else DEGREE, BUILD_WIDTH) for m in self.members]

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """The k nearest found for each query, as point numbers padded with the number of points."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
        out = []
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            at = np.zeros((len(part), 1), np.int32)
            for links in self.layers[:-1]:
                at = searched(self.points, links, part, at, 8)[0]
            out.append(searched(self.points, self.layers[-1], part, at, max(width, k))[0][:, :k])
        return np.concatenate(out)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, key): rows that take part, vectors as doubles, `key` names equal vectors."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    d = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    d = d.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    return d.withColumn("key", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))


def _packed(arrays: list[np.ndarray]) -> bytes:
    return b"".join(np.int64(len(a)).tobytes() + np.ascontiguousarray(a, np.int32).tobytes() for a in arrays)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key", ignore_index=True)
    vectors = np.stack(pdf["v"].to_numpy())
    graph = Graph(vectors)
    sizes = pdf["ids"].map(len).to_numpy()
    return pd.DataFrame(
        {
            "dim": pdf["dim"].iloc[:1],
            "shard": pdf["shard"].iloc[:1],
            "vectors": [vectors.astype(np.float64).tobytes()],
            "ids": [np.concatenate(pdf["ids"].to_numpy()).astype(np.int64).tobytes()],
            "offsets": [np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes()],
            "layers": [_packed([x.ravel() for x in graph.layers])],
        }
    )


def _read(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """A stored graph with its vectors, ids and the offsets of each point's ids."""
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    flat, at, layers = np.frombuffer(row["layers"], np.uint8), 0, []
    while at < len(flat):
        size = int(flat[at : at + 8].view(np.int64)[0])
        layers.append(flat[at + 8 : at + 8 + 4 * size].view(np.int32).reshape(len(vectors) + 1, -1))
        at += 8 + 4 * size
    return Graph(vectors, layers), vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64)


def _best(q: np.ndarray, own: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids."""
    order = np.lexsort((own, -score, q))
    q, own, score = q[order], own[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], own[keep], score[keep]


def _found(stored: tuple, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k nearest found in one graph for each query."""
    graph, vectors, ids, offsets = stored
    found = graph.search(queries, k, width)
    hit = found < len(vectors)
    q, p = np.nonzero(hit)[0], found[hit]
    score = (queries[q] * vectors[p]).sum(1)
    count = offsets[p + 1] - offsets[p]
    each = np.repeat(np.arange(len(p)), count)
    own = ids[offsets[p][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
    return _best(q[each], own, score[each], k)


def _search(k: int, width: int):
    """Rows sorted by (dim, group, copy, nth): a group's graphs (nth 0), then the queries that pass them (nth 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, graphs = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if len(keys) else []
            for start, end in zip(edge[:-1], edge[1:]):
                part = batch.slice(start, end - start)
                here = tuple(keys[start, :3])
                if here != place:
                    place, graphs = here, []
                if keys[start, 3] == 0:
                    graphs += [_read(row) for row in part.to_pylist()]
                    continue
                if not graphs:
                    continue
                for i in range(0, part.num_rows, 1024):
                    some = part.slice(i, 1024)
                    queries = some.column("v").flatten().to_numpy().reshape(some.num_rows, -1)
                    each = [_found(g, queries, k + 1, width) for g in graphs]
                    q, own, score = _best(*(np.concatenate(x) for x in zip(*each)), k + 1)
                    yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(q)), pa.array(own), pa.array(score)], ["key", "vec_id", "score"])

    return run


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    rows = usable(df, id_col, vector_col)
    nth = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    least = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    points = least.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    points = written(points.withColumn("dim", F.size("v")), "points")
    n_shards = max(1, -(-points.count() // shard_points))
    points = points.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"))
    graphs = points.repartition(max(n_shards, 1), "dim", "shard").groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, vectors binary, ids binary, offsets binary, layers binary")
    graphs = written(graphs, "graphs")

    asked = written(rows.where(F.col("vec_id") % every == 0).select("vec_id", "key", "v"), "asked")
    distinct = asked.groupBy("key").agg(F.first("v").alias("v")).withColumn("dim", F.size("v"))
    n_groups = -(-n_shards // min(GROUP, max(1, n_shards // COPIES)))
    copies = max(1, COPIES // n_groups)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = graphs.select("dim", (F.col("shard") % n_groups).alias("group"), each(copies).alias("copy"), F.lit(0).alias("nth"), "vectors", "ids", "offsets", "layers")
    passing = distinct.select("dim", each(n_groups).alias("group"), F.pmod(F.hash("key"), F.lit(copies)).alias("copy"), F.lit(1).alias("nth"), "key", "v")
    rows = held.unionByName(passing, allowMissingColumns=True).repartition(n_groups * copies, "dim", "group", "copy")
    rows = rows.sortWithinPartitions("dim", "group", "copy", "nth")
    found = rows.mapInArrow(_search(k, width), "key string, vec_id long, score double")

    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    mine = asked.select(F.col("vec_id").alias("query_id"), "key").distinct()
    final = mine.join(found, "key").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
