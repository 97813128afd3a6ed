"""Streams: progress logs and items that are packed as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palletry.operators.packing import PRIORITIES, SPARE


def packed_stream(items: DataFrame, capacity: float, priority: str = "best_fit") -> DataFrame:
    """(instance, seq, item, bin) for a stream of items (instance, seq, item): the state is the room of an instance's bins."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        room = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values("seq", ignore_index=True)
        bins = []
        for item in rows["item"]:
            have = np.array([*room, *[capacity] * SPARE])
            fits = np.flatnonzero(have >= item)
            if not len(fits):
                bins.append(-1)
                continue
            b = int(fits[int(np.argmax(PRIORITIES[priority](item, have[fits])))])
            room += [float(capacity)] * (b + 1 - len(room))
            room[b] -= float(item)
            bins.append(b)
        state.update((room,))
        yield rows.assign(bin=bins)[["instance", "seq", "item", "bin"]]

    d = items.select("instance", "seq", F.col("item").cast("double").alias("item"))
    return d.groupBy("instance").applyInPandasWithState(run, "instance long, seq long, item double, bin long", "room array<double>", "append", GroupStateTimeout.NoTimeout)


def best_so_far(progress: DataFrame) -> DataFrame:
    """One row from a progress log, kept up to date: the best score, its iteration and the failures by kind."""
    return progress.agg(F.max("best_score").alias("best_score"), F.max_by("iteration", "best_score").alias("iteration"), F.count("*").alias("steps"), F.count(F.when(~F.col("step_ok"), 1)).alias("failures"))
