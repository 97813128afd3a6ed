"""Best-fit packing of token sequences by a plan over the histogram of lengths.

1. One pass encodes whole documents, appends an end token, and cuts what is longer than a sequence into pieces. It
   numbers the pieces of each length inside their task as it goes.
2. Counts by task and length, summed up, give each piece its rank within its length; no length is sorted or gathered.
3. The histogram, at most `capacity` counts, is packed on the driver: lengths fall, and each goes where the least room
   that suffices is left. Sequences with the same room are one run of numbers, so the work depends on the number of
   lengths, not of documents. This gives the same number of sequences as best-fit decreasing over the pieces.
4. The plan is broadcast (a row for each length and run it uses), and pieces take their slots by rank within length.

Defined results: a null or empty text has the end token only; texts of any length are cut, none is shortened; equal
rows are pieces of their own, as are rows with equal or null ids; an empty table gives an empty result. Special tokens'
strings in a text are special tokens, as in the tokenizer's library. Further columns aren't looked at.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from palletry.llm.bpe_lexicon import MARKS, SLICE, Encoder, Model
from palletry.llm.common import slices, written

CAPACITY, END, CACHED, CACHED_CHARS = 4096, 1, 1_000_000, 64


class ByteEncoder(Encoder):
    """Encodes texts to little-endian 32-bit ids; the cache holds bytes, so that a text's ids are one join."""

    def _learn(self, chunks: set) -> None:
        """Letters are one piece, as in `Encoder`; with a mark after them they take the letters' ids if the cache has these."""
        cache, letters, marked, others = self.cache, [], [], {}
        for c in chunks:
            if isinstance(c, int):
                cache[c] = array("I", (c,)).tobytes()
            elif c.isalpha():
                letters.append(c)
            elif c[-1:] in MARKS and c[:-1].isalpha():
                marked.append(c)
            else:
                others[c] = self.model.pieces(c)
        bare = {c[:-1] for c in marked}.difference(letters)
        found = {w: cache[w] for w in bare if w in cache}
        unseen = [*letters, *dict.fromkeys([*(w for w in bare if w not in found), *(c[-1] for c in marked), *chain.from_iterable(others.values())])]
        found.update(zip(unseen, self.model.merged_bytes([w.encode() for w in unseen])))
        cache.update((c, found[c]) for c in letters)
        cache.update((c, found[c[:-1]] + found[c[-1]]) for c in marked)
        cache.update((c, b"".join(map(found.__getitem__, ps))) for c, ps in others.items())

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), SLICE):
            split = [self._chunks(t) for t in texts[i : i + SLICE]]
            seen, cache = set().union(*split), self.cache
            new = {c for c in seen if c not in cache}  # a difference from the keys would walk the whole cache
            if len(cache) + len(new) > CACHED:
                self.cache, new = {}, seen
            self._learn(new)
            for chunks in split:
                yield b"".join(map(self.cache.__getitem__, chunks))
            for c in new:
                if isinstance(c, str) and len(c) > CACHED_CHARS:
                    del self.cache[c]


_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(shipped) -> ByteEncoder:
    name, source = shipped.value
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = ByteEncoder(Model(source), None)
    return _ENCODERS[name]


def pieces(df: DataFrame, model_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth[, ids]): whole documents' tokens in pieces; `nth` counts the pieces
    of one length in the part, which is the task."""
    with open(model_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, f.read()))
    tail = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(shipped), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in slices(batches):
            owner, numbers, raws, nth = [], [], [], []
            for row, raw in enumerate(encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                raw += tail
                for at in range(0, len(raw), 4 * capacity):
                    own = raw[at : at + 4 * capacity]
                    owner.append(row)
                    numbers.append(at // (4 * capacity))
                    raws.append(own)
                    nth.append(seen[len(own) // 4])
                    seen[len(own) // 4] += 1
            number = np.array(numbers, np.int64)
            columns = [
                b.column(0).take(pa.array(owner, pa.int32())),
                pa.array(number, pa.int32()),
                pa.array(number * capacity),
                pa.array([len(r) // 4 for r in raws], pa.int64()),
                pa.array(map(zlib.crc32, raws), pa.int64()),
                pa.array([part] * len(raws), pa.int32()),
                pa.array(nth, pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(r, np.int32) for r in raws], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if keep_ids else [])])

    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else "")
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, pieces a sequence, first sequence, first offset): best-fit decreasing over counts.

    `runs` holds, by the room left, runs (first, number) of sequences. The run of least room that suffices takes as many
    pieces a sequence as fit, as a best fit would put them there one by one.
    """
    rows, rooms, runs, sequences = [], [], {}, 0

    def leave(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            each = room // length
            full = min(number, left // each)
            for count, many in ((full, each), (min(number - full, 1), left - full * each)):
                if count and 0 < many <= each:
                    rows.append((length, rank, count * many, each, first, capacity - room))
                    leave(room - many * length, first, count)
                    rank, left, first, number = rank + count * many, left - count * many, first + count, number - count
            leave(room, first, number)
    return np.array(rows, np.int64).reshape(-1, 6)


def placed(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A written table of pieces (with length, part and nth) with `sequence_id` and `offset` instead of part and nth."""
    counts = written(df.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = planned(histogram, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shipped = df.sparkSession.sparkContext.broadcast(plan[order])
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_ahead"))
    names = [c for c in df.columns if c not in ("part", "nth")]
    ranked = df.join(ahead, ["part", "length"]).select(*names, (F.col("nth") + F.col("_ahead")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shipped.value
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        for b in batches:
            rank = b.column("_rank").to_numpy()
            row = rows[np.searchsorted(keys, b.column("length").to_numpy() * (1 << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            place = [pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * row[:, 0])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *place], [*names, "sequence_id", "offset"])

    kinds = dict(df.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def packed(df: DataFrame, model_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): each piece of each document and its place."""
    return placed(written(pieces(df, model_path, capacity, end, id_col, text_col, keep_ids), "pieces"), capacity)


def sequences(packed_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, of `packed(..., keep_ids=True)`; each is at most `capacity` long."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed_ids.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
