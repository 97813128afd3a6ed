"""Tours of small instances by named methods, in numpy; instances run in parallel, guided search takes many of a task at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Most tasks that instances are dealt to.
TASKS = 10_000
#: Entries of the matrices that guided search takes at a time (256 instances of 50 nodes).
ENTRIES = 640_000
#: Instances of one size whose matrices are searched at a time.
LANES = 16
#: The surveyed budget of guided search: (rounds, moves a round).
BUDGETS = {"guided": (1200, 30)}


def distances(xy: np.ndarray) -> np.ndarray:
    return np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))


def length_of(d: np.ndarray, tour: np.ndarray) -> float:
    return float(d[tour, np.roll(tour, -1)].sum())


def nearest_neighbour(d: np.ndarray, start: int = 0) -> np.ndarray:
    tour, open_ = [start], np.ones(len(d), bool)
    open_[start] = False
    while open_.any():
        tour.append(int(np.where(open_, d[tour[-1]], np.inf).argmin()))
        open_[tour[-1]] = False
    return np.array(tour)


def constructive(d: np.ndarray, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)) -> np.ndarray:
    """Builds a tour by a score of distance to here, mean and spread of distances to the open nodes, and distance home."""
    tour, open_ = [0], list(range(1, len(d)))
    while open_:
        o = np.array(open_)
        rest = d[np.ix_(o, o)]
        n = max(len(o) - 1, 1)
        mean = rest.sum(1) / n
        spread = np.sqrt(np.maximum((rest**2).sum(1) / n - mean**2, 0))
        score = weights[0] * d[tour[-1], o] - weights[1] * mean + weights[2] * spread - weights[3] * d[0, o]
        tour.append(int(o[score.argmin()]))
        open_.remove(tour[-1])
    return np.array(tour)


def _best_move(d: np.ndarray, tours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each tour, over its own distances: the change of length by the best move, and the tour after it."""
    lanes, n = tours.shape
    k, lane = np.arange(n), np.arange(lanes)
    ring = np.concatenate([tours, tours[:, :1]], 1)
    e = d.reshape(-1)[(lane * n * n)[:, None, None] + (ring * n)[:, :, None] + ring[:, None]]
    near, edge = e[:, :-1, :-1], e[:, k, k + 1]
    turn = near + e[:, 1:, 1:]
    turn -= edge[:, :, None]
    turn -= edge[:, None]
    turn[:, k, k] = 0
    found = turn.reshape(lanes, -1).argmin(1)
    i, j = np.minimum(*divmod(found, n)), np.maximum(*divmod(found, n))
    move = near + e[:, :-1, 1:]
    move += (e[:, (k - 1) % n, k + 1] - edge[:, k - 1] - edge)[:, :, None]
    move -= edge[:, None]
    move[:, k, k] = move[:, k, k - 1] = 0
    found_ = move.reshape(lanes, -1).argmin(1)
    s, t = divmod(found_, n)
    by_turn, by_move = turn.reshape(lanes, -1)[lane, found], move.reshape(lanes, -1)[lane, found_]
    turns = (by_turn <= by_move)[:, None]
    return np.minimum(by_turn, by_move), np.where(turns, _turned(tours, i + 1, j), _moved(tours, s, t))


def _turned(tours: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tours with the places i to j, one pair a tour, turned round."""
    k, i, j = np.arange(tours.shape[1]), i[:, None], j[:, None]
    return np.take_along_axis(tours, np.where((k >= i) & (k <= j), i + j - k, k), 1)


def _moved(tours: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tours with the node at place i put behind the one at j."""
    k, i, j = np.arange(tours.shape[1]), i[:, None], j[:, None]
    to = j + (j < i)
    return np.take_along_axis(tours, np.where(k == to, i, k + ((k >= i) & (k < to)) - ((k > to) & (k <= i))), 1)


def _improved(d: np.ndarray, tours: np.ndarray, rounds: int = 1000) -> np.ndarray:
    tours, live = tours.copy(), np.arange(len(tours))
    least = -1e-12 * np.abs(d).max((1, 2), initial=0)
    for _ in range(rounds if tours.shape[1] > 3 else 0):
        left = []
        for own in np.split(live, range(LANES, len(live), LANES)):  # matrices that a core's cache holds
            change, after = _best_move(d[own], tours[own])
            better = change < least[own]
            tours[own[better]] = after[better]
            left.append(own[better])
        live = np.concatenate(left)
        if not len(live):
            break
    return tours


def improve(d: np.ndarray, tour: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """2-opt and relocation, the best move a round, until none helps."""
    return _improved(d[None], np.asarray(tour)[None], rounds)[0]


def _disturbed(w: np.ndarray, worth: np.ndarray, guide: np.ndarray, penalty: np.ndarray, step: np.ndarray, tours: np.ndarray, moves: int) -> np.ndarray:
    """Tours after so many moves at penalised edges each; `w`, `worth` and `penalty` are kept up to date, all by tour and pair of nodes.

    The edge of greatest worth gets a penalty, then its ends are tried in turn: the best turn of the way behind the place, and the best
    new place of the node there, by the distances with penalties. A place where either helps is a move. The first place stays.
    """
    n, out = tours.shape[1], tours.copy()
    rows = w.reshape(-1, n)
    w, worth, guide, penalty = (a.reshape(-1) for a in (w, worth, guide, penalty))
    ahead, barred = np.arange(1, n + 1) % n, np.where(np.tri(n, dtype=bool), np.inf, 0)
    live, done = np.arange(len(tours)), np.zeros(len(tours), int)
    stop = np.zeros(len(tours), bool)
    while True:
        t, lane = out[live], np.arange(len(live))
        base, least, by = live * n * n, -1e-9 * step[live], step[live]
        start = (lane * n)[:, None]
        own = t + start  # places of a tour's nodes in rows of all live tours
        after = own[:, ahead]
        pairs = base[:, None] + t * n + t[:, ahead]
        edge, value = w.take(pairs), worth.take(pairs)
        while not stop.any():
            at = value[:, :-1].argmax(1)
            u, v = t[lane, at], t[lane, at + 1]
            uv, vu = base + u * n + v, base + v * n + u
            more = penalty[uv] + 1
            penalty[uv] = penalty[vu] = more
            worth[uv] = value[lane, at] = guide[uv] / (1 + more)
            worth[vu] = guide[vu] / (1 + more)
            w[uv] += by
            w[vu] = edge[lane, at] = w[uv]
            stop = ~(value[lane, at] > 0)
            for i in (at, at + 1):
                inside, i = (i > 0) & (i < n - 1), np.clip(i, 1, n - 2)
                helped = np.zeros(len(live), bool)
                for turning in (True, False):
                    here, last = t[lane, i], t[lane, i - 1]
                    near = rows.take(live * n + here, 0)
                    first = edge[lane, i - 1]
                    change = near.take(after)
                    if turning:
                        change += rows.take(live * n + last, 0).take(own)
                        change += barred.take(i, 0)
                        saved = first
                    else:
                        change += near.take(own)
                        change[lane, i] = change[lane, i - 1] = np.inf
                        saved = first + edge[lane, i] - w[base + last * n + t[lane, i + 1]]
                    change -= edge
                    j = change.argmin(1)
                    b = np.flatnonzero(inside & (change[lane, j] - saved < least))
                    if len(b):
                        new = (_turned if turning else _moved)(t[b], i[b], j[b])
                        t[b], own[b] = new, new + start[b]
                        next_ = new[:, ahead]
                        after[b] = next_ + start[b]
                        pairs = base[b, None] + new * n + next_
                        edge[b], value[b] = w.take(pairs), worth.take(pairs)
                        helped[b] = True
                done += helped
            stop |= done >= moves
        out[live] = t
        live, done = live[~stop], done[~stop]
        if not len(live):
            return out
        stop = np.zeros(len(live), bool)


def guided_many(d: np.ndarray, guide: np.ndarray, rounds: int = BUDGETS["guided"][0], moves: int = BUDGETS["guided"][1]) -> np.ndarray:
    """A tour for each of several instances of as many nodes, by guided local search over their matrices. None depends on the others.

    A round makes edges of great guide / (1 + penalty) longer, one by one, and improves at their ends by the longer distances until
    `moves` places were; then the whole tour is improved by the true ones. The shortest tour found is kept.
    """
    n = d.shape[1]
    tours = _improved(d, np.stack([nearest_neighbour(a) for a in d]))
    best, lengths = tours.copy(), np.array([length_of(a, t) for a, t in zip(d, tours)])
    go = np.flatnonzero((lengths > 0) & np.isfinite(d).all((1, 2))) if n > 4 else np.zeros(0, int)  # others have no edge to penalise
    if not len(go):
        return best
    d, guide, t, step, lane = d[go], guide[go].astype(float), tours[go], 0.1 * lengths[go] / n, np.arange(len(go))
    w, worth, penalty = d.copy(), guide.copy(), np.zeros_like(d)
    for _ in range(rounds):
        t = _improved(d, _disturbed(w, worth, guide, penalty, step, t, moves))
        found = d[lane[:, None], t, np.roll(t, -1, 1)].sum(1)
        shorter = go[found < lengths[go]]
        best[shorter], lengths[go] = t[found < lengths[go]], np.minimum(found, lengths[go])
    return best


def guided(d: np.ndarray, guide: np.ndarray, rounds: int = BUDGETS["guided"][0], moves: int = BUDGETS["guided"][1]) -> np.ndarray:
    """Guided local search on one instance."""
    return guided_many(d[None], guide[None], rounds, moves)[0]


SCHEMA = "instance long, pos long, node long, x double, y double"


def _ordered(pdf: pd.DataFrame, tour: np.ndarray) -> pd.DataFrame:
    return pdf.iloc[tour].assign(pos=range(len(tour)))[["instance", "pos", "node", "x", "y"]]


def _guided_tours(found: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tours of some instances; those of one size are searched together."""
    for n in sorted({len(p) for p in found}):
        own = [p for p in found if len(p) == n]
        d = np.stack([distances(p[["x", "y"]].to_numpy(float)) for p in own])
        yield pd.concat([_ordered(p, t) for p, t in zip(own, guided_many(d, d))])


def tours(nodes: DataFrame, method: str = "nearest") -> DataFrame:
    """(instance, pos, node, x, y): a tour of each instance (instance, node, x, y) by a named method.

    Instances are few bytes and much work, so their number, not their size, sets that of the tasks: left to itself, Spark merges
    small partitions and runs all instances in one task. Guided search takes many instances of a task at a time, as many as `ENTRIES` says.
    """
    if method not in ("nearest", "constructive", "guided"):
        raise ValueError(method)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        d = distances(pdf[["x", "y"]].to_numpy(float))
        return _ordered(pdf, nearest_neighbour(d) if method == "nearest" else constructive(d))

    def guide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, found = None, []
        for batch in batches:
            whole = [p for _, p in (batch if rest is None else pd.concat([rest, batch])).groupby("instance", sort=False, dropna=False)]
            rest = whole.pop() if whole else rest  # the next batch may go on with it
            found += whole
            if sum(len(p) ** 2 for p in found) >= ENTRIES:
                yield from _guided_tours(found)
                found = []
        yield from _guided_tours(found if rest is None else [*found, rest])

    nodes = nodes.select("instance", "node", "x", "y")
    sizes = nodes.groupBy("instance").agg(F.count("*").alias("n")).agg(F.count("*").alias("instances"), F.sum(F.col("n").cast("double") ** 2).alias("entries")).first()
    if method == "guided":
        cores = nodes.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(sizes.instances, cores * math.ceil((sizes.entries or 0) / ENTRIES / cores), TASKS))
        return nodes.repartition(tasks, "instance").sortWithinPartitions("instance", "node").mapInPandas(guide, SCHEMA)
    tasks = max(1, min(sizes.instances, TASKS))
    return nodes.repartition(tasks, "instance").groupBy("instance").applyInPandas(run, SCHEMA)
