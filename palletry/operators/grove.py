"""Many trees at once over binned rows: forests and boosted trees of all folds and trials share their passes.

Rows that agree in the ranges of all features are one place, with its number of rows a label and fold. Places lie in blocks of bounded
size. A pass takes all trees one level down: a task sums, for its block and its share of the trees, weights and targets by node, feature
and range; the sums of a tree meet in one task, which picks the splits; the driver holds the trees only. A forest's tree draws each
place's rows with replacement (above `PARTS` rows in so many equal parts) and tries some of the features at a node; a boosted one is
fitted to the logistic loss by Newton's rule. Left-out folds and rows of fold -1 reach no tree that scores them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from palletry.sources.snapshots import stored

#: Places of a block, rows of a place that are drawn one by one, nodes and trees whose sums are made at a time.
PLACES, PARTS, NODES, TREES = 65_536, 16, 512, 1_024
#: Bytes of sums that a task sends on at a time.
BYTES = 8_000_000
#: Boosting rounds between two stores of the scores so far.
ROUNDS = 8


@dataclass(frozen=True)
class Grove:
    """A forest (`step` None) or boosted trees: how many, how deep (None: until leaves are pure), least weight of a leaf, and the fold left out."""

    name: str
    trees: int
    depth: int | None
    least: float = 1.0
    step: float | None = None
    without: int | None = None
    seed: int = 42


class _Tree:
    """Nodes in the order they were made: feature (-1: a leaf), the last range that goes left, the left child (the right one follows), value."""

    def __init__(self, value: float = 0.0):
        self.feature, self.last, self.left, self.value = np.array([-1], np.int8), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.array([value], np.float32)
        self.start = 0  # of the nodes that may still be split

    @property
    def open(self) -> int:
        return len(self.feature) - self.start

    def leaves(self, flat: np.ndarray, at_row: np.ndarray) -> np.ndarray:
        """The nodes without children that rows end in; `flat` has their ranges, from the places `at_row` on."""
        at, feature, left, last = np.zeros(len(at_row), np.int64), self.feature.astype(np.int64), self.left.astype(np.int64), self.last
        if feature[0] < 0:
            return at
        node, live = at.copy(), None  # rows that go on, if not all do
        while len(at):
            f = feature.take(at)
            if f.min() < 0:
                stop = f < 0
                live = np.arange(len(at)) if live is None else live
                node[live[stop]] = at[stop]
                go = ~stop
                live, at, f, at_row = live[go], at[go], f[go], at_row[go]
            at = left.take(at) + (flat.take(at_row + f) > last.take(at))
        return node

    def split(self, feature: np.ndarray, last: np.ndarray, values: np.ndarray) -> None:
        """Splits the open nodes whose feature isn't -1; `values` has two a node."""
        own = np.flatnonzero(feature >= 0)
        first = len(self.feature)
        self.feature[self.start :], self.last[self.start :] = feature, last
        self.left[self.start + own] = first + 2 * np.arange(len(own))
        self.start = first
        more = 2 * len(own)
        self.feature = np.r_[self.feature, np.full(more, -1, np.int8)]
        self.last, self.left = np.r_[self.last, np.zeros(more, np.uint8)], np.r_[self.left, np.zeros(more, np.int32)]
        self.value = np.r_[self.value, values[own].reshape(-1).astype(np.float32)]


def _draws() -> np.ndarray:
    """For each mean up to `PARTS`, Poisson numbers at 65,536 even places of their distribution."""
    at, out = (np.arange(65_536) + 0.5) / 65_536, np.zeros((PARTS + 1, 65_536), np.uint8)
    for mean in range(1, PARTS + 1):
        k = np.arange(80)
        p = np.exp(k * np.log(mean) - mean - np.cumsum(np.log(np.maximum(k, 1))))
        out[mean] = np.searchsorted(np.cumsum(p), at)
    return out


def _tried(tree: int, seed: int, nodes: range, width: int, some: int) -> np.ndarray:
    """(nodes, some): the features that are tried at a tree's nodes."""
    if some == width:
        return np.tile(np.arange(width), (len(nodes), 1))
    u = np.random.default_rng([seed, tree, nodes.start]).random((len(nodes), width))
    return u.argsort(1)[:, :some]


class _Block:
    """Places of a block: their ranges and rows by label and fold, the last fold being that of rows that no tree sees."""

    def __init__(self, row, width: int, folds: int):
        self.block, self.group = int(row.block), int(row.part)
        self.flat = np.frombuffer(row.bins, np.uint8)
        self.bins = self.flat.reshape(-1, width)
        self.at = np.arange(len(self.bins)) * width
        self.counts = np.frombuffer(row.counts).reshape(-1, 2, folds)
        self.scores = np.frombuffer(row.scores, np.float32).reshape(-1, len(self.bins)) if row.scores else ()
        self._seen: dict = {}

    def rows(self, without: int | None) -> tuple[np.ndarray, ...]:
        """Place, label and number of the rows that a model may see; where in the table of draws theirs begin, and the rows of a part."""
        if without not in self._seen:
            c = self.counts[:, :, :-1].sum(2) - (0 if without is None else self.counts[:, :, without])
            place, label = np.nonzero(c > 0)
            n = c[place, label]
            mean = np.minimum(n, PARTS)
            self._seen[without] = place, label.astype(float), n, mean.astype(np.int64) * 65_536, n / mean
        return self._seen[without]


class Trained:
    """Binned rows as blocks, and groves over them."""

    def __init__(self, places: DataFrame, width: int, k: int, ranges: int, cores: int):
        """`places` has (bins, label, fold, n); labels are 0 or 1, folds 0 to k - 1, or -1."""
        self.width, self.k, self.ranges = width, k, ranges
        f = F.when(F.col("fold") < 0, k).otherwise(F.col("fold"))
        each = [F.coalesce(F.sum(F.when((F.col("label") == y) & (f == i), F.col("n").cast("double"))), F.lit(0.0)) for y in (0, 1) for i in range(k + 1)]
        wide = stored(places.groupBy("bins").agg(F.array(*each).alias("c")), "places")
        size = wide.agg(F.count("*").alias("n"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(2 * k + 2)]).first()
        self.total = np.array([size[f"c{i}"] or 0.0 for i in range(2 * k + 2)]).reshape(2, k + 1)[:, :k]
        blocks = max(1, math.ceil(size.n / PLACES))
        self.parts = max(1, math.ceil(cores / blocks))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [(b.column(0).flatten().to_numpy().reshape(-1, width), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows]
            if found:
                bins, counts = (np.concatenate(a) for a in zip(*found))
                order = np.lexsort(bins.T)
                yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "bins": [bins[order].astype(np.uint8).tobytes()], "counts": [counts[order].tobytes()]})

        rows = stored(wide.select("bins", "c").repartition(blocks, "bins").mapInArrow(packed, "block int, bins binary, counts binary"), "blocks")
        parts = rows.crossJoin(rows.sparkSession.range(self.parts).select(F.col("id").cast("int").alias("part")))
        self.state = stored(parts.repartitionByRange(blocks * self.parts, "block", "part").withColumn("scores", F.lit(b"")), "shares")

    def _start(self, g: Grove) -> float:
        n = self.total.sum(1) - (0 if g.without is None else self.total[:, g.without])
        p = float(np.clip(n[1] / max(n.sum(), 1), 1e-6, 1 - 1e-6))
        return p if g.step is None else math.log(p / (1 - p))

    def _level(self, state: DataFrame, jobs: list[tuple[Grove, int, _Tree, list[_Tree]]], starts: list[float]) -> None:
        """Takes the trees of (grove, number, tree, the trees before it whose scores aren't stored) one level down."""
        width, folds, ranges, parts = self.width, self.k + 1, self.ranges, self.parts
        some = [width if g.step is not None else math.ceil(math.sqrt(width)) for g, *_ in jobs]
        live = [i for i, (*_, t, _before) in enumerate(jobs) if t.open]

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            draws, found, held = _draws().reshape(-1), [], 0
            for pdf in batches:
                for row in pdf.itertuples():
                    b = _Block(row, width, folds)
                    scores = b.scores
                    for i in live:
                        if i % parts != b.group:
                            continue
                        g, number, tree, before = jobs[i]
                        place, y, n, begin, part = b.rows(g.without)
                        if g.step is None:
                            u = np.random.default_rng([g.seed, number, b.block]).integers(0, 65_536, len(n), np.uint16)
                            weight = draws.take(begin + u) * part
                            own = np.flatnonzero(weight)
                            place, weight = place[own], weight[own]
                            target = weight * y[own]
                        else:
                            margin = scores[i // parts].astype(float) if len(scores) else np.full(len(b.bins), starts[i])
                            for t in before:
                                margin += t.value[t.leaves(b.flat, b.at)]
                            p = 1 / (1 + np.exp(-margin[place]))
                            weight, target = n * p * (1 - p), n * (y - p)
                        node = tree.leaves(b.flat, b.at.take(place)) - tree.start
                        own = np.flatnonzero(node >= 0)
                        node, place, weight, target = node.take(own), place.take(own), weight.take(own), target.take(own)
                        for at in range(0, tree.open, NODES):
                            size = min(NODES, tree.open - at)
                            own = slice(None) if tree.open <= NODES else np.flatnonzero((node >= at) & (node < at + size))
                            nodes, flat = node[own] - at, place[own] * width
                            tried, cells = _tried(number, g.seed, range(tree.start + at, tree.start + at + size), width, some[i]), size * some[i] * ranges
                            sums = np.zeros((2, cells))
                            for j in range(some[i]):
                                code = (nodes * some[i] + j) * ranges + b.flat.take(flat + tried[:, j].take(nodes))
                                sums[0] += np.bincount(code, weight[own], cells)
                                sums[1] += np.bincount(code, target[own], cells)
                            found.append((i, at, b.block, sums.tobytes()))
                            held += sums.nbytes
                            if held > BYTES:
                                yield pd.DataFrame(found, columns=["tree", "at", "block", "sums"])
                                found, held = [], 0
            if found:
                yield pd.DataFrame(found, columns=["tree", "at", "block", "sums"])

        def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, total, found = None, None, []
            for pdf in batches:
                for row in pdf.itertuples():
                    if key is not None and key != (row.tree, row.at):
                        found.append(_picked(key, total))
                        key = None
                    sums = np.frombuffer(row.sums)
                    key, total = ((row.tree, row.at), sums.copy()) if key is None else (key, total + sums)
            if key is not None:
                yield pd.DataFrame([*found, _picked(key, total)], columns=["tree", "at", "feature", "last", "values"])  # a few bytes a node

        def _picked(key: tuple[int, int], total: np.ndarray) -> tuple:
            g, number, tree, _ = jobs[key[0]]
            weight, target = total.reshape(2, -1, some[key[0]], ranges)
            least = max(g.least, 1e-9) if g.step is None else 1e-3
            feature, last, values = _best(weight, target, least)
            tried = _tried(number, g.seed, range(tree.start + key[1], tree.start + key[1] + len(weight)), width, some[key[0]])
            feature = np.where(feature >= 0, tried[np.arange(len(weight)), feature], -1).astype(np.int8)
            return *key, feature.tobytes(), last.astype(np.uint8).tobytes(), values.tobytes()

        sums = state.mapInPandas(counted, "tree int, at int, block int, sums binary")
        tasks = max(self.parts, math.ceil(len(live) / 64))
        found = sums.repartition(tasks, "tree", "at").sortWithinPartitions("tree", "at", "block").mapInPandas(picked, "tree int, at int, feature binary, last binary, values binary").collect()
        splits: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r.tree, r["at"])):
            splits.setdefault(r.tree, []).append((np.frombuffer(r.feature, np.int8), np.frombuffer(r["last"], np.uint8), np.frombuffer(r["values"]).reshape(-1, 2)))
        for i in live:
            g, _, tree, _ = jobs[i]
            if i in splits:
                feature, last, values = (np.concatenate(a) for a in zip(*splits[i]))
                tree.split(feature, last, values * (1 if g.step is None else g.step))
            else:
                tree.start = len(tree.feature)

    def _forests(self, groves: list[Grove]) -> dict[Grove, list[_Tree]]:
        jobs = [(g, number, _Tree(self._start(g)), []) for g in groves for number in range(g.trees)]
        jobs.sort(key=lambda j: j[0].depth if j[0].depth is not None else 256)
        for first in range(0, len(jobs), TREES):
            own = jobs[first : first + TREES]
            for level in range(max(256 if g.depth is None else g.depth for g, *_ in own)):
                now = [j for j in own if j[2].open and (j[0].depth is None or level < j[0].depth)]
                if not now:
                    break
                self._level(self.state, now, [])
        out: dict[Grove, list[_Tree]] = {g: [] for g in groves}
        for g, _, tree, _ in jobs:
            out[g].append(tree)
        return out

    def _boosted(self, groves: list[Grove]) -> dict[Grove, list[_Tree]]:
        out: dict[Grove, list[_Tree]] = {g: [] for g in groves}
        width, folds, parts, state, kept = self.width, self.k + 1, self.parts, self.state, 0
        starts = [self._start(g) for g in groves]
        for number in range(max((g.trees for g in groves), default=0)):
            if number - kept == ROUNDS:
                state, kept = self._kept(state, [out[g][kept:number] for g in groves], starts), number
            trees = [_Tree() if number < g.trees else None for g in groves]
            for level in range(max(256 if g.depth is None else g.depth for g, t in zip(groves, trees) if t)):
                jobs = [(g, number, t if t and (g.depth is None or level < g.depth) else _closed(), out[g][kept:]) for g, t in zip(groves, trees)]
                if not any(t.open for _, _, t, _ in jobs):
                    break
                self._level(state, jobs, starts)
            for g, t in zip(groves, trees):
                if t:
                    out[g].append(t)
        return out

    def _kept(self, state: DataFrame, trees: list[list[_Tree]], starts: list[float]) -> DataFrame:
        """`state` with the scores of boosted groves after some more trees."""
        width, folds, parts = self.width, self.k + 1, self.parts

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    b = _Block(row, width, folds)
                    old = b.scores
                    own = range(b.group, len(trees), parts)
                    new = [(old[i // parts] if len(old) else np.float32(starts[i])) + sum((t.value[t.leaves(b.flat, b.at)] for t in trees[i]), np.zeros(len(b.bins), np.float32)) for i in own]
                    scores = np.stack(new).astype(np.float32).tobytes() if new else b""
                    yield pd.DataFrame({"block": [row.block], "bins": [row.bins], "counts": [row.counts], "part": [row.part], "scores": [scores]})

        return stored(state.mapInPandas(run, "block int, bins binary, counts binary, part int, scores binary"), "boosted")

    def scores(self, groves: list[Grove]) -> DataFrame:
        """(bins, fold, a column a name), stored: each place of a fold scored by the groves that left the fold out, those of fold -1 by the groves that left none out."""
        with ThreadPoolExecutor(2) as pool:
            run = inheritable_thread_target(self.state.sparkSession)
            forests = pool.submit(run(self._forests), [g for g in groves if g.step is None])
            boosted = pool.submit(run(self._boosted), [g for g in groves if g.step is not None])
            trees = forests.result() | boosted.result()
        names, width, folds, parts = list(dict.fromkeys(g.name for g in groves)), self.width, self.k + 1, self.parts
        by_fold = {(folds - 1 if g.without is None else g.without, g.name): (g, self._start(g), trees[g]) for g in groves}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pandas().itertuples():
                    b = _Block(row, width, folds)
                    for f in sorted({f for f, _ in by_fold}):
                        own = np.flatnonzero(b.counts[:, :, f].sum(1) > 0)[b.group :: parts]
                        bins, at, columns = b.bins[own], b.at[own], []
                        for name in names:
                            g, start, own_trees = by_fold[f, name]
                            total = np.zeros(len(own))
                            for t in own_trees:
                                total += t.value[t.leaves(b.flat, at)]
                            columns.append(total / max(len(own_trees), 1) if g.step is None else 1 / (1 + np.exp(-(start + total))))
                        lists = pa.ListArray.from_arrays(np.arange(0, bins.size + 1, width, dtype=np.int32), pa.array(bins.reshape(-1).astype(float)))
                        fold = pa.array(np.full(len(own), f if f < folds - 1 else -1, np.int32))
                        yield pa.RecordBatch.from_arrays([lists, fold, *[pa.array(c) for c in columns]], ["bins", "fold", *names])

        return stored(self.state.mapInArrow(run, "bins array<double>, fold int, " + ", ".join(f"`{n}` double" for n in names)), "scores")


def _closed() -> _Tree:
    t = _Tree()
    t.start = 1
    return t


def _best(weight: np.ndarray, target: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sums (nodes, features, ranges): the feature (-1: none helps) and last range of each node's best split, and the means of both sides.

    The best split has the greatest sum of target**2 / weight over both sides; for labels this is the one of least Gini impurity.
    """
    w, t = weight.cumsum(2), target.cumsum(2)
    all_w, all_t = w[:, :1, -1:], t[:, :1, -1:]
    left_w, left_t = w[:, :, :-1], t[:, :, :-1]
    right_w, right_t = all_w - left_w, all_t - left_t
    fits = (left_w >= least) & (right_w >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_t**2 / left_w + right_t**2 / right_w - all_t**2 / all_w, -np.inf)
    flat = gain.reshape(len(w), -1)
    at, node = flat.argmax(1), np.arange(len(w))
    feature, last = divmod(at, gain.shape[2])
    helps = flat[node, at] > 1e-9 * np.maximum(all_w[:, 0, 0], 1e-9)
    sides = [(a[node, feature, last], b[node, feature, last]) for a, b in ((left_t, left_w), (right_t, right_w))]
    values = np.stack([np.where(helps, s / np.where(helps, v, 1), 0) for s, v in sides], 1)
    return np.where(helps, feature, -1), last, values
