"""One-dimensional packing: bounds, checks and an online kernel."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palletry.operators.population import ranked_within


def lower_bound(items: DataFrame, capacity: float) -> DataFrame:
    """(instance, n_items, total, bound): the least number of bins by volume."""
    g = items.groupBy("instance").agg(F.count("*").alias("n_items"), F.sum("item").alias("total"))
    return g.withColumn("bound", F.ceil(F.col("total") / capacity).cast("long"))


def excess(used: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row: mean bins, mean bound and the excess in per cent."""
    m = used.join(bounds, "instance").agg(F.avg("bins").alias("mean_bins"), F.avg("bound").alias("mean_bound"))
    return m.withColumn("excess_pct", 100 * (F.col("mean_bins") / F.col("mean_bound") - 1))


def bin_loads(packed: DataFrame) -> DataFrame:
    return packed.groupBy("instance", "bin").agg(F.sum("item").alias("load"), F.count("*").alias("n_items"))


def fill_fitness(packed: DataFrame, capacity: float) -> DataFrame:
    """(instance, bins, fitness): used bins and the mean square of their fill."""
    return bin_loads(packed).groupBy("instance").agg(F.count("*").alias("bins"), F.avg(F.pow(F.col("load") / capacity, 2)).alias("fitness"))


def validity(items: DataFrame, packed: DataFrame, capacity: float) -> DataFrame:
    """(instance, same_items, fits, valid): the packing holds exactly the items, and no bin overflows."""
    left = items.groupBy("instance", "item").agg(F.count("*").alias("n"))
    right = packed.groupBy("instance", "item").agg(F.count("*").alias("m"))
    same = left.join(right, ["instance", "item"], "full").groupBy("instance").agg(F.min((F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).cast("int")).alias("same"))
    fits = bin_loads(packed).groupBy("instance").agg(F.min((F.col("load") <= capacity).cast("int")).alias("fits"))
    both = same.join(fits, "instance", "left")
    return both.select("instance", (F.col("same") == 1).alias("same_items"), (F.coalesce("fits", F.lit(1)) == 1).alias("fits"), ((F.col("same") == 1) & (F.coalesce("fits", F.lit(1)) == 1)).alias("valid"))


def renumbered(df: DataFrame, label: str, position: str, *by: str) -> DataFrame:
    """`df` with `number`, from 0 in the order in which labels first appear in each group, and `n_labels`.

    The first positions, a row a label, are ranked in two levels; rows themselves only meet their label's number.
    """
    firsts = df.groupBy(*by, F.col(label).alias("_label")).agg((-F.min(position)).alias("_first"))
    ranks = ranked_within(firsts, list(by), "_first", "_label").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_label", (F.col("rank") - 1).alias("number"), F.col("group_size").alias("n_labels"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col(label).eqNullSafe(F.col("_label")))
    return df.join(ranks, same).select(*df.columns, "number", "n_labels")


def best_fit(item: float, room: np.ndarray) -> np.ndarray:
    """Priorities of bins for an item: least room first."""
    return -(room - item)


def first_fit(item: float, room: np.ndarray) -> np.ndarray:
    return -np.arange(len(room), dtype=float)


def score_step(item: float, room: np.ndarray) -> np.ndarray:
    """A score of each fitting bin, negative unless the item fills it, less the score of the fitting bin before it."""
    score = (room - room.max()) ** 2 / item + room**2 / item**2 + room**2 / item**3
    return np.diff(np.where(room > item, -score, score), prepend=0.0)


PRIORITIES = {"best_fit": best_fit, "first_fit": first_fit, "score_step": score_step}
#: Unused bins at the end that can win: alike in themselves, but `score_step` tells the first from those behind another.
SPARE = 2


class OnlinePacker:
    """Packs items one after another: the first bin of highest priority among those with room; -1 if none has.

    There are as many bins as items. Only those up to the last used one and `SPARE` after it can win, as any further one
    has the priority of the one before it. The state is the rooms of the used bins, so items may come in pieces.
    """

    def __init__(self, capacity: float, priority: str = "best_fit"):
        self.capacity, self.score, self.used = float(capacity), PRIORITIES[priority], 0
        self.room = np.full(64, self.capacity)

    def pack(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(items), -1, np.int64)
        for i, item in enumerate(items):
            if self.used + SPARE > len(self.room):
                self.room = np.r_[self.room, np.full(len(self.room), self.capacity)]
            fits = np.flatnonzero(self.room[: self.used + SPARE] >= item)
            if len(fits):
                b = fits[int(np.argmax(self.score(item, self.room[fits])))]
                self.room[b] -= item
                out[i] = b
                self.used = max(self.used, b + 1)
        return out


class BestFitPacker(OnlinePacker):
    """The same for `best_fit`: bins by room in order, so an item costs a search, not a look at every bin."""

    def __init__(self, capacity: float):
        self.capacity, self.used = float(capacity), 0
        self.rooms: list[float] = []
        self.bins: dict[float, list[int]] = {}

    def _put(self, bin_: int, room: float) -> None:
        if room not in self.bins:
            insort(self.rooms, room)
            self.bins[room] = []
        heappush(self.bins[room], bin_)

    def pack(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(items), -1, np.int64)
        for i, item in enumerate(items.tolist()):
            if item > self.capacity:
                continue
            at = bisect_left(self.rooms, item)
            if at < len(self.rooms):
                room = self.rooms[at]
                out[i] = heappop(self.bins[room])
                if not self.bins[room]:
                    del self.bins[room], self.rooms[at]
            else:
                room, out[i] = self.capacity, self.used
                self.used += 1
            self._put(int(out[i]), room - item)
        return out


def packer(capacity: float, priority: str) -> OnlinePacker:
    return BestFitPacker(capacity) if priority == "best_fit" else OnlinePacker(capacity, priority)


def pack_online(items: np.ndarray, capacity: float, priority: str = "best_fit") -> np.ndarray:
    """The bin of each item, in order of arrival."""
    return packer(capacity, priority).pack(np.asarray(items, float))


def online(items: DataFrame, capacity: float, priority: str = "best_fit") -> DataFrame:
    """(instance, seq, item, bin): each instance is packed in order of `seq`.

    Spark sorts a task's rows, spilling if need be; they pass as a stream, of which the task holds a batch and the bins of the
    instance at hand. So an instance of any number of items fits a task, though one task has to pack it, as each item's bin
    depends on all before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            instance = b.column(0).to_pylist()
            item = b.column(2).to_numpy()
            edges = [0, *[i for i in range(1, len(instance)) if instance[i] != instance[i - 1]], len(instance)]
            out = np.empty(len(instance), np.int64)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                if state is None or instance[lo] != current:
                    current, state = instance[lo], packer(capacity, priority)
                out[lo:hi] = state.pack(item[lo:hi])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], ["instance", "seq", "item", "bin"])

    kinds = dict(items.dtypes)
    rows = items.select("instance", "seq", F.col("item").cast("double").alias("item")).repartition("instance").sortWithinPartitions("instance", "seq")
    return rows.mapInArrow(run, f"instance {kinds['instance']}, seq {kinds['seq']}, item double, bin long")


def packing_report(packed: DataFrame, capacity: float) -> DataFrame:
    """(instance, bins, n_items, total, bound) of packed items, in one aggregation: used bins against the least number by volume."""
    used = F.count_distinct(F.when((F.col("bin") >= 0) & (F.col("item") > 0), F.col("bin"))).cast("long")
    g = packed.groupBy("instance").agg(used.alias("bins"), F.count("*").alias("n_items"), F.sum("item").alias("total"))
    return g.withColumn("bound", F.ceil(F.col("total") / capacity).cast("long"))


def used_bins(packed: DataFrame) -> DataFrame:
    """(instance, bins): bins that hold anything; bins of zero-size items alone count as unused."""
    return packed.where("bin >= 0 and item > 0").groupBy("instance").agg(F.count_distinct("bin").cast("long").alias("bins"))
