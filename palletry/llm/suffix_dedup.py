"""Removal of repeated byte strings by sparse suffix sorting.

Every byte that a `LENGTH`-byte string covers which also starts anywhere else (any document, this one included) goes.

1. Anchors. Each window of LENGTH bytes names one of its GRAM-byte grams, the rightmost of least hash. As the choice
   depends on the window's bytes alone, equal windows name the same place in themselves. About one byte in 70 is named.
2. Anchors whose gram occurs once are out: one shuffle of (hash, text key, position), without text.
3. For the others the bytes around them are sent to the tasks that hold their gram. A bit map of the repeated grams,
   of fixed size, tells the mappers which; what it lets through needlessly is compared all the same and finds no equal.
4. Inside a group the right contexts and the reversed left contexts are put in suffix order, deep-shallow:
   multikey quicksort on 8-byte symbols to a shallow depth, then a blind trie for each class that still agrees.
   With both orders and their common prefix lengths, windows at offset o are equal if they agree in o bytes to the
   left and LENGTH-o to the right; the least and largest such o bound the bytes to remove.
5. All grams that occur more often than `HOT` (a second bit map; what it lets through is treated alike) have their
   equal contexts combined first, in the mappers and then by an aggregation. Windows of the distinct ones are counted
   by the SHA-256 of their bytes, and each occurrence looks its context's offsets up: no task holds a hot group.

Equal texts are found by their hashes beforehand; a mapper sends each text once. Defined results: null is the empty
text; texts shorter than LENGTH lose nothing; equal texts of LENGTH bytes or more, repeated rows too, lose everything;
null ids are rows like others; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palletry.llm.common import bit_map, is_marked, mixed, prefix_hash, slices, span_hash, written

LENGTH, GRAM, SHALLOW, HOT, MAP_BITS = 200, 64, 3, 100_000, 26
SLICE_BYTES, GROUP_ROWS = 1_000_000, 20_000


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, gram hash, all prefix hashes): the places that the windows of some texts name."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    b = np.frombuffer(b"".join(texts), np.uint8)
    prefix = prefix_hash(b)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none.astype(np.uint64), prefix
    at = np.arange(len(b) - gram + 1)
    h = span_hash(prefix, at, at + gram)
    span = length - gram + 1
    order = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    order = np.r_[order, np.full(-len(order) % span, ~np.uint64(0))].reshape(-1, span)
    ahead = np.minimum.accumulate(order, 1).ravel()
    behind = np.minimum.accumulate(order[:, ::-1], 1)[:, ::-1].ravel()
    n = len(b) - length + 1
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    end = np.cumsum(size)
    start = np.arange(n)
    doc = np.repeat(np.arange(len(texts)), size)[:n]
    fits = start + length <= end[doc]
    named = (np.uint64(0xFFFFFFFF) - (least[fits] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    doc = doc[fits]
    first = np.r_[True, (named[1:] != named[:-1]) | (doc[1:] != doc[:-1])] if len(named) else np.zeros(0, bool)
    named, doc = named[first], doc[first]
    return doc, named - (end - size)[doc], h[named], prefix


class BlindTrie:
    """Orders distinct strings of one length: nodes hold the depth of a branching and its bytes only."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self._add(i)

    @staticmethod
    def _agree(a: bytes, b: bytes) -> int:
        lo, hi = 0, len(a)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def _add(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):
            kids = node[1]
            node = kids.get(s[node[0]], next(iter(kids.values())))
        depth = self._agree(s, self.strings[node])
        old, above, node = s[depth], None, self.root
        other = self.strings[self._leaf(depth, s)][depth]
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][old] = i
            return
        branch = [depth, {other: node, old: i}]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]]] = branch

    def _leaf(self, depth: int, s: bytes) -> int:
        """Some string below the place where `s` leaves the trie at `depth`."""
        node = self.root
        while not isinstance(node, int):
            node = node[1][s[node[0]]] if node[0] < depth else next(iter(node[1].values()))
        return node

    def ordered(self) -> tuple[list[int], list[int]]:
        """String numbers in order, and each one's common prefix length with the one before it."""
        order, common, stack = [], [], [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, int):
                order.append(node)
                common.append(depth)
            else:
                kids = sorted(node[1].items(), reverse=True)
                stack += [(kid, node[0] if k + 1 < len(kids) else depth) for k, (_, kid) in enumerate(kids)]
        return order, common


def suffix_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows inside each group and the common prefix length of neighbours (-1 between groups)."""
    m, width = rows.shape
    symbols = np.zeros((m, -(-width // 8) * 8), np.uint8)
    symbols[:, :width] = rows
    symbols = symbols.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    edge = np.r_[True, group[order][1:] != group[order][:-1]]
    depth, split = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    common = np.full(m, -1, np.int64)
    shallow = min(SHALLOW, symbols.shape[1])
    at, cls = np.arange(m), np.cumsum(edge) - 1
    while True:  # one three-way partition of every open class a round
        size = np.bincount(cls, minlength=1)
        open_ = (size[cls] > 1) & (depth[at] < shallow)
        at, cls = at[open_], cls[open_]
        if not len(at):
            break
        first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        size = np.diff(np.r_[first, len(at)])
        word = symbols[order[at], depth[at]]
        three = np.sort(np.stack([word[first], word[first + size // 2], word[first + size - 1]]), 0)
        pivot = np.repeat(three[1], size)
        side = (word > pivot) * 2 + (word == pivot)  # 0 below, 1 equal, 2 above
        key = np.repeat(np.arange(len(first)), size) * 3 + side
        moved = np.argsort(key, kind="stable")
        order[at], key = order[at][moved], key[moved]
        new = np.r_[True, key[1:] != key[:-1]]
        cut = at[new & ~np.r_[True, key[1:] // 3 != key[:-1] // 3]]
        edge[cut], split[cut] = True, depth[cut]
        depth[at] += key % 3 == 1  # only the equal ones go on to the next symbol
        cls = np.cumsum(new) - 1
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], m]
    deep = np.flatnonzero(ends - starts > 1)
    pairs = deep[(ends - starts)[deep] == 2]
    if len(pairs):  # two strings: their first difference is the whole trie
        a, b = order[starts[pairs]], order[starts[pairs] + 1]
        differs = rows[a] != rows[b]
        at = np.where(differs.any(1), differs.argmax(1), width)
        inside = np.minimum(at, width - 1)
        swap = (at < width) & (rows[a, inside] > rows[b, inside])
        order[starts[pairs]], order[starts[pairs] + 1] = np.where(swap, b, a), np.where(swap, a, b)
        common[starts[pairs] + 1] = at
    for k in deep[(ends - starts)[deep] > 2]:
        members: dict[bytes, list[int]] = {}
        for i in order[starts[k] : ends[k]].tolist():
            members.setdefault(rows[i].tobytes(), []).append(i)
        strings = list(members)
        here, depth = BlindTrie(strings).ordered()
        at = int(starts[k])
        for s, c in zip(here, depth):
            for j, i in enumerate(members[strings[s]]):
                order[at] = i
                if at > starts[k]:
                    common[at] = width if j else c
                at += 1
    at = np.flatnonzero(split >= 0)
    differ = symbols[order[at], split[at]] ^ symbols[order[at - 1], split[at]]
    common[at] = split[at] * 8 + (differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
    return order, common


def repeated_offsets(group: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and largest offset of a repeated window around it; (1, 0) if there is none.

    `left`: bytes before the anchor, nearest first; `right`: bytes from the anchor on; n_left, n_right: how many are real.
    """
    m = len(group)
    low, high = np.ones(m, np.int64), np.zeros(m, np.int64)
    (lo, lc), (ro, rc) = suffix_order(group, left), suffix_order(group, right)
    left_class, right_class = np.empty(m, np.int64), np.empty(m, np.int64)
    found = np.zeros(m, bool)
    for o in range(left.shape[1] + 1):
        left_class[lo] = np.cumsum(lc < o)
        right_class[ro] = np.cumsum(rc < length - o)
        fits = (n_left >= o) & (n_right >= length - o)
        fits &= (np.bincount(left_class, fits)[left_class] > 1) & (np.bincount(right_class, fits)[right_class] > 1)
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        pair = left_class[at] * (m + 1) + right_class[at]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = at[order[np.r_[False, same] | np.r_[same, False]]]
        low[twice] = np.where(found[twice], low[twice], o)
        high[twice] = o
        found[twice] = True
    return low, high


def _anchor_batches(batches, length, gram):
    """Slices of texts, each distinct text of a partition once, with their anchors."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches):
        a, b, raw = (batch.column(i).to_pylist() for i in range(3))
        fresh = []
        for i, t in enumerate(raw):
            if t is not None and len(t) >= length and (a[i], b[i]) not in seen:
                seen.add((a[i], b[i]))
                fresh.append(i)
        at = 0
        while at < len(fresh):
            part, total = [], 0
            while at < len(fresh) and (not part or total + len(raw[fresh[at]]) < SLICE_BYTES):
                part.append(fresh[at])
                total += len(raw[fresh[at]])
                at += 1
            texts = [raw[i] for i in part]
            doc, pos, h, prefix = anchors(texts, length, gram)
            yield np.array([a[i] for i in part], np.int64), np.array([b[i] for i in part], np.int32), texts, doc, pos, h, prefix


def _gram_rows(length, gram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, _, doc, pos, h, _ in _anchor_batches(batches, length, gram):
            occurrence = mixed(a[doc].view(np.uint64) * np.uint64(3) + pos.astype(np.uint64) + (b[doc].astype(np.int64).view(np.uint64) << np.uint64(32)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(occurrence.view(np.int64))], ["g", "occurrence"])

    return run


def _marked(batches, length, gram, marks, often, hot):
    """Slices of texts with the anchors whose gram is marked, either the hot ones or the others."""
    for a, b, texts, doc, pos, h, _ in _anchor_batches(batches, length, gram):
        keep = is_marked(marks, h) & (is_marked(often, h) == hot)
        doc, pos, h = doc[keep], pos[keep], h[keep]
        around = [texts[d][max(0, p - length + gram) : p + length] for d, p in zip(doc.tolist(), pos.tolist())]
        yield a[doc], b[doc], pos, h, around


def _context_rows(length, gram, bits, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, pos, h, around in _marked(batches, length, gram, bits.value, often.value, False):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(a), pa.array(b), pa.array(pos.astype(np.int32)), pa.array(around, pa.binary())], ["g", "a", "b", "pos", "context"])

    return run


def _context_key(context: bytes, left: int) -> bytes:
    return hashlib.blake2b(context, digest_size=32, salt=left.to_bytes(4, "little")).digest()


def _hot_occurrences(length, gram, bits, often):
    """(k, a, b, pos): where the contexts of hot grams stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, pos, _, around in _marked(batches, length, gram, bits.value, often.value, True):
            keys = [_context_key(c, min(p, length - gram)) for c, p in zip(around, pos.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(a), pa.array(b), pa.array(pos.astype(np.int32))], ["k", "a", "b", "pos"])

    return run


def _hot_contexts(length, gram, bits, often):
    """(k, left, context, n): the distinct contexts of hot grams in a slice, and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, pos, _, around in _marked(batches, length, gram, bits.value, often.value, True):
            found: dict[tuple[bytes, int], int] = {}
            for c, p in zip(around, pos.tolist()):
                found[c, min(p, length - gram)] = found.get((c, min(p, length - gram)), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([_context_key(*x) for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["k", "left", "context", "n"]
            )

    return run


def _hot_windows(length, gram):
    """(w, k, o, n): digests of the windows of each distinct context by their offset."""
    reach = np.arange(length - gram + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                k, left, context, n = (batch.column(j).slice(i, 500) for j in range(4))
                raw = context.to_pylist()
                size = np.fromiter(map(len, raw), np.int64, len(raw))
                start = left.to_numpy()[:, None] - reach
                row, o = np.nonzero((start >= 0) & (start + length <= size[:, None]))
                w = [hashlib.sha256(raw[i][j : j + length]).digest() for i, j in zip(row.tolist(), start[row, o].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), k.take(pa.array(row)), pa.array(o.astype(np.int32)), pa.array(n.to_numpy()[row])], ["w", "k", "o", "n"])

    return run


def _hot_spans(texts: DataFrame, length: int, gram: int, marks, often) -> DataFrame:
    contexts = texts.mapInArrow(_hot_contexts(length, gram, marks, often), "k binary, left int, context binary, n long")
    contexts = written(contexts.groupBy("k", "left", "context").agg(F.sum("n").alias("n")), "contexts")
    windows = contexts.mapInArrow(_hot_windows(length, gram), "w binary, k binary, o int, n long")
    twice = windows.groupBy("w", "o").agg(F.sum("n").alias("n")).where("n > 1").select("w", "o")  # o: a place counts once for each gram
    offsets = written(windows.join(twice, ["w", "o"]).groupBy("k").agg(F.min("o").alias("low"), F.max("o").alias("high")), "offsets")
    here = texts.mapInArrow(_hot_occurrences(length, gram, marks, often), "k binary, a long, b int, pos int").join(offsets, "k")
    return here.select("a", "b", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end"))


def _compared(length, gram):
    """(a, b, start, end) to remove, from context rows sorted by gram; complete groups are taken together."""
    reach = length - gram

    def spans(table: pa.Table) -> pa.RecordBatch:
        g, a, b, pos = (table.column(i).to_numpy() for i in range(4))
        context = table.column(4).combine_chunks()
        if isinstance(context, pa.ChunkedArray):
            context = pa.concat_arrays(context.chunks)
        raw, offset = np.frombuffer(context.buffers()[2], np.uint8), np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
        n_left = np.minimum(pos, reach).astype(np.int64)
        n_right = offset[1:] - offset[:-1] - n_left
        home = offset[:-1] + n_left
        order = np.lexsort((pos, b, a, g))
        once = order[np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (g, a, b, pos)], 0)]]
        g, a, b, pos, n_left, n_right, home = (x[once] for x in (g, a, b, pos, n_left, n_right, home))
        back, on = np.arange(1, reach + 1), np.arange(length)
        left, right = np.zeros((len(g), reach), np.uint8), np.zeros((len(g), length), np.uint8)
        for i in range(0, len(g), 4096):
            h, part = home[i : i + 4096, None], slice(i, i + 4096)
            left[part] = np.where(back <= n_left[part, None], raw[np.maximum(h - back, 0)], 0)
            right[part] = np.where(on < n_right[part, None], raw[np.minimum(h + on, len(raw) - 1)], 0)
        low, high = repeated_offsets(g, left, n_left, right, n_right, length)
        hit = low <= high
        return pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit]), pa.array((pos - high)[hit].astype(np.int32)), pa.array((pos - low + length)[hit].astype(np.int32))], ["a", "b", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < GROUP_ROWS:
                continue
            table = pa.Table.from_batches(held)
            g = table.column(0).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield spans(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return run


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the union of some spans, how many lie inside, and in how many runs."""
    out, at, runs = [], 0, 0
    for start, end in sorted(spans):
        if start > at or not runs:
            out.append(text[at:start])
            runs += 1
            at = end
        else:
            at = max(at, end)
    out.append(text[at:])
    kept = b"".join(out)
    return kept, len(text) - len(kept), runs


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.hash(text).alias("b"), text.cast("binary").alias("raw"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, map_bits: int = MAP_BITS) -> DataFrame:
    """(a, b, start, end): byte spans to remove, by text key; `docs` as made by `keyed`."""
    spark = docs.sparkSession
    texts = docs.select("a", "b", "raw")
    grams = texts.mapInArrow(_gram_rows(length, gram), "g long, occurrence long")
    grams = grams.groupBy("g").agg(F.min("occurrence").alias("x"), F.max("occurrence").alias("y"), F.count("*").alias("n")).where("x <> y")
    grams = written(grams.select("g", "n"), "grams")
    marks = bit_map(grams, "g", map_bits)
    often = bit_map(grams.where(F.col("n") > hot), "g", map_bits)
    any_hot = bool(often.any())
    marks, often = spark.sparkContext.broadcast(marks), spark.sparkContext.broadcast(often)

    contexts = texts.mapInArrow(_context_rows(length, gram, marks, often), "g long, a long, b int, pos int, context binary")
    compared = contexts.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(length, gram), "a long, b int, start int, end int")
    if any_hot:
        compared = compared.unionByName(_hot_spans(texts, length, gram, marks, often))
    copies = docs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.octet_length("raw")).alias("end")).where((F.col("n") > 1) & (F.col("end") >= length))
    return compared.unionByName(copies.select("a", "b", F.lit(0).alias("start"), F.col("end").cast("int").alias("end")))


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans, kept_sha256): every row with its remaining bytes."""
    docs = keyed(df, id_col, text_col)
    spans = repeated_spans(docs, **options).groupBy("a", "b").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans")
    both = docs.join(spans, ["a", "b"], "left").select("id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, counts = [], []
            for raw, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, gone, runs = _kept(raw, [(x["start"], x["end"]) for x in s or ()])
                kept.append(left)
                counts.append((len(raw), gone, runs))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *n, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
