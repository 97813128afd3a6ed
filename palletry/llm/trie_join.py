"""N-gram Jaccard join by prefix trees: groups of documents linked by 100 * |A & B| >= PERCENT * |A | B|.

1. Each text becomes the sorted set of its K-word shingles' hashes; equal sets form a class with one representative.
2. Screen: of linked sets at most n - ceil(PERCENT n / 100) shingles of either are missing in the other. Each class sends
   the `SCREEN` % of its shingles with the least hashes; a class of whose sent shingles more are found in no other class
   goes on alone. Shingles that a chunk of texts holds twice are counted there and sent twice at most.
3. The texts of the classes that are left meet their shingles' frequencies among each other. This gives one global order,
   rare shingles first; linked sets share one of the first n - ceil(PERCENT n / 100) + 1. Each class keeps these (its prefix)
   as narrow rows, with the size up to which what is left of the set behind the shingle allows a link.
4. Rounds: every shingle that classes of different groups share names a few of them as pivots, at most one a lane of
   groups, texts without shingles of their own first. Its other classes are held against them unless their sizes rule a
   link out; each pair once, whatever shingles it shares. Then groups that links join are one group, pivots leave the
   shingle, rows without a possible partner go, and there are four times as many lanes, so that rounds grow with the
   logarithm of a group. So neither all pairs of a group are listed nor does a shingle's group lie in one task.
5. A pair is decided on whole sets: a pivot's classes, in parts of bounded size, are stored as a trie in one order of their
   shingles, which near copies share for long. The pivot walks it a few levels at a time with the overlaps so far; rows
   that the rest of their length can't lift to the bound are dead, and subtrees of dead rows are skipped.

Defined results: null and empty texts have no shingles and are alone; a text of fewer than K words is one shingle; rows
with equal sets, repeated rows too, share a group; null ids are ignored in `component_id`, which is null if a group has
no other; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.llm.common import bit_map, is_marked, row_key, shingle_sets, slices, written
from palletry.llm.components import components

K, PERCENT, SCREEN, CHUNK, PART, MAP_BITS, LANES = 5, 80, 30, 500_000, 1_000_000, 26, 4

_CLASS = ["id", "a", "b", "key", "d", "c", "n"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = row_key(F.col(id_col), F.col(text_col))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.hash(text).alias("b"), text.cast("binary").alias("raw"), key.alias("key"))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def spare(n, percent: int = PERCENT):
    """How many of a set's `n` shingles a linked set may lack; for numbers, arrays and columns."""
    return F.floor(n * (100 - percent) / 100) if isinstance(n, Column) else n * (100 - percent) // 100


def sent(n, percent: int = PERCENT, screen: int = SCREEN):
    """How many shingles of a set of `n` are sent to the screen: some beyond those that a linked set may lack."""
    if isinstance(n, Column):
        return F.least(n, F.greatest(spare(n, percent) + 1, F.floor(n * screen / 100)))
    return min(n, max(spare(n, percent) + 1, n * screen // 100))


def _class_rows(k: int):
    """One row (id, a, b, key, d, c, n) for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sizes = [], []
            for s in shingle_sets(batch.column(3).to_pylist(), k):
                keys.append(digest(s) if len(s) else None)
                sizes.append(len(s))
            heads = [short(d) if d else None for d in keys]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(keys, pa.binary()), pa.array(heads, pa.int64()), pa.array(sizes, pa.int64())], _CLASS)

    return run


#: What a row (s, c, v) of the screen says; larger v are sums: v - SUM shingles of class c are known to be shared.
ASKED, EVIDENCE, SUM = 0, 1, 2


def _screen_rows(k: int, percent: int, screen: int, chunk: int):
    """Rows (s, c, v) of the sets that a partition meets for the first time."""

    def told(held: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        size = np.array([len(h) for h in held])
        s, c = np.concatenate(held), np.array(names, np.int64)
        owner = np.repeat(np.arange(len(c)), size)
        order = np.argsort(s, kind="stable")
        first = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]])
        count = np.diff(np.r_[first, len(s)])
        shared = np.zeros(len(s), bool)
        shared[order] = np.repeat(count > 1, count)
        ends = order[np.r_[first[count > 1], (first + count - 1)[count > 1]]]
        sums = np.bincount(owner[shared], minlength=len(c))
        at = np.r_[np.flatnonzero(~shared), ends]
        v = np.r_[np.full(len(at) - len(ends), ASKED), np.full(len(ends), EVIDENCE), SUM + sums].astype(np.int32)
        # a sum has no shingle; its class's number spreads these rows
        return pa.RecordBatch.from_arrays([pa.array(np.r_[s[at].view(np.int64), c]), pa.array(np.r_[c[owner[at]], c]), pa.array(v)], ["s", "c", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, names, total = set(), [], [], 0
        for batch in slices(batches):
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                held.append(s[: sent(len(s), percent, screen)].copy())
                names.append(short(d))
                total += len(held[-1])
                if total > chunk:
                    yield told(held, names)
                    held, names, total = [], [], 0
        if held:
            yield told(held, names)

    return run


def screened(docs: DataFrame, classes: DataFrame, k: int, percent: int, screen: int, chunk: int) -> DataFrame:
    """The classes that share enough of their sent shingles with any other class."""
    rows = docs.select("raw").mapInArrow(_screen_rows(k, percent, screen, chunk), "s long, c long, v int")
    same = Window.partitionBy("s")
    seen = F.when(F.col("v") < SUM, F.col("c"))
    rows = rows.withColumns({"lo": F.min(seen).over(same), "hi": F.max(seen).over(same)})
    found = F.when(F.col("v") >= SUM, F.col("v") - SUM).when((F.col("v") == ASKED) & (F.col("lo") < F.col("hi")), 1).otherwise(0)
    # A class that several partitions hold is counted as often.
    sums = rows.groupBy("c").agg(F.sum(found).alias("found"), F.count(F.when(F.col("v") >= SUM, 1)).alias("copies"))
    n = F.col("n")
    return classes.join(sums, "c").where(F.col("found") >= (sent(n, percent, screen) - spare(n, percent)) * F.col("copies")).drop("found", "copies")


def candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, raw): the representatives' texts of the classes in `wanted`, each once, as a written table.

    A bit map of their text hashes, of fixed size, spares most other texts the shuffle of the join.
    """
    wanted = written(wanted.select("c", "rep.a", "rep.key"), "wanted")
    marks = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "a", MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in slices(batches, 2000):
            batch = batch.filter(pa.array(is_marked(marks.value, batch.column(0).to_numpy())))
            fresh = []
            for key in batch.column(2).to_pylist():
                fresh.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    some = docs.select("a", "raw", "key").mapInArrow(run, "a long, raw binary, key string")
    found = some.join(wanted.select("c", "key"), "key").groupBy("key").agg(F.first("c").alias("c"), F.first("raw").alias("raw"))
    return written(found.select("c", "raw"), "candidates")


def _token_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            sets = list(shingle_sets(batch.column(1).to_pylist(), k))
            size = np.array([len(s) for s in sets], np.int32)
            if len(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(size, size))], ["s", "c", "n"])

    return run


def prefixes(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(s, c, n, far, own, label): the shingles of each class's prefix, from rare to frequent, that other classes hold too.

    `far`: the size of the largest set that this shingle, if it is the first common one, and what is left of the set behind
    it can link with; `own`: the share of shingles that no other class holds; `label`: the group, at first the class itself.
    """
    rows = texts.mapInArrow(_token_rows(k), "s long, c long, n int")
    rows = rows.join(rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "s")
    own = F.col("n") - F.count("*").over(Window.partitionBy("c"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("df", "s")) - 1
    rows = rows.select("s", "c", "n", own.alias("own"), place.alias("place")).where(F.col("own") + F.col("place") <= spare(F.col("n"), percent))
    far = F.floor((F.col("n") - F.col("own") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    return rows.select("s", "c", "n", far.cast("int").alias("far"), (F.col("own") / F.col("n")).alias("own"), F.col("c").alias("label"))


class Trie:
    """Sets in one order of their shingles, frequent ones first, as a flat trie: a node is a shingle at a depth, shared by
    the rows from `begin` to `end`; nodes stand by depth."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        self.shingles, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int32)
        self.rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        paths = [np.sort(x) for x in np.split(self.rank[token], np.cumsum(size)[:-1])]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.length = size[self.order]
        m, longest = len(sets), int(size.max())
        nodes, begins, depths, open_, made, before = [], [], [], np.zeros(longest, np.int32), 0, None
        end = np.full(int(size.sum()), m, np.int32)
        for i, p in enumerate(paths[j] for j in self.order):
            common = 0
            if before is not None:
                k = min(len(p), len(before))
                differs = p[:k] != before[:k]
                common = int(differs.argmax()) if differs.any() else k
                end[open_[common : len(before)]] = i
            fresh = len(p) - common
            open_[common : len(p)] = np.arange(made, made + fresh)
            nodes.append(p[common:])
            begins.append(np.full(fresh, i, np.int32))
            depths.append(np.arange(common, len(p), dtype=np.int32))
            made += fresh
            before = p
        depth = np.concatenate(depths)
        by_depth = np.argsort(depth, kind="stable")
        self.node, self.begin, self.end = np.concatenate(nodes)[by_depth], np.concatenate(begins)[by_depth], end[:made][by_depth]
        self.steps = [0]
        while self.steps[-1] < longest:
            self.steps.append(min(longest, max(64, self.steps[-1] * 2)))
        self.cut = np.searchsorted(depth[by_depth], self.steps)

    def linked(self, probe: np.ndarray, percent: int) -> list[int]:
        """The numbers of the sets that are linked with `probe`, a sorted set."""
        mark = np.zeros(len(self.rank), bool)
        mark[self.rank[np.isin(self.shingles, probe, assume_unique=True)]] = True
        m = len(self.length)
        need = -(-percent * (len(probe) + self.length) // (100 + percent))
        alive, overlap = np.minimum(len(probe), self.length) >= need, np.zeros(m, np.int64)
        for level in range(len(self.steps) - 1):
            if not alive.any():
                break
            part = slice(self.cut[level], self.cut[level + 1])
            here = mark[self.node[part]]
            b, e = self.begin[part][here], self.end[part][here]
            living = np.r_[0, np.cumsum(alive)]
            wanted = living[e] > living[b]
            b, e = b[wanted], e[wanted]
            overlap += np.cumsum(np.bincount(b, minlength=m + 1) - np.bincount(e, minlength=m + 1))[:m]
            alive &= overlap + np.maximum(self.length - self.steps[level + 1], 0) >= need
        return [self.order[i] for i in np.flatnonzero(alive & (overlap >= need)).tolist()]


def _linked_rows(k: int, percent: int, chunk: int):
    """(x, y): the links among rows (x, part, y, raw), sorted by these; the pivot's own row, with y null, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, sets, names, total = None, None, [], [], 0
        found: list[tuple[int, int, int, int]] = []

        def closed():
            nonlocal sets, names, total
            if sets:
                found.extend((*key[:2], *names[i]) for i in Trie(sets).linked(probe, percent))
            sets, names, total = [], [], 0

        def told():
            out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["x", "lx", "y", "ly"])
            found.clear()
            return out

        for batch in slices(batches, 200):
            x, lx, part, y, ly, raw = (batch.column(i).to_pylist() for i in range(6))
            for at, s in enumerate(shingle_sets(raw, k)):
                if y[at] is None:
                    closed()
                    key, probe = (x[at], lx[at], part[at]), s.copy()
                    continue
                sets.append(s.copy())
                names.append((y[at], ly[at]))
                total += len(s)
                if total > chunk:
                    closed()
            yield told()
        closed()
        yield told()

    return run


def links(pairs: DataFrame, texts: DataFrame, k: int, percent: int, chunk: int, part: int) -> DataFrame:
    """The linked ones of `pairs` (x, lx, y, ly, n), n being the size of y; a pivot's pairs are split into parts of bounded size."""
    sizes = pairs.groupBy("x").agg(F.ceil(F.sum("n") / part).alias("parts"))
    dealt = pairs.join(sizes, "x").withColumn("part", F.pmod(F.hash("y"), F.col("parts"))).select("x", "lx", "part", "y", "ly")
    pivots = dealt.groupBy("x", "part").agg(F.first("lx").alias("lx")).select("x", "lx", "part", F.lit(None).cast("long").alias("y"), F.lit(None).cast("long").alias("ly"))
    rows = dealt.join(texts.withColumnRenamed("c", "y"), "y").select("x", "lx", "part", "y", "ly", "raw")
    rows = rows.unionByName(pivots.join(texts.withColumnRenamed("c", "x"), "x").select("x", "lx", "part", "y", "ly", "raw"))
    rows = rows.repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    return rows.mapInArrow(_linked_rows(k, percent, chunk), "x long, lx long, y long, ly long")


def pairable(rows: DataFrame) -> DataFrame:
    """The rows whose shingle may be the first that they have in common with a class of another group.

    Sizes must reach each other: n <= far on either side. Of two such rows one has n <= far for its own size. The sizes of
    a shingle's classes are summed up by bands, of which there are as many as the logarithm of the largest size.
    """
    able, band = F.col("far") >= F.col("n"), F.floor(F.log(F.col("n")) / F.log(F.lit(1.05)))
    bands = rows.groupBy("s", able.alias("able"), band.alias("band")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("far").alias("far"), F.min("n").alias("least"))
    bands = bands.groupBy("s").agg(F.collect_list(F.struct("able", "lo", "hi", "far", "least")).alias("bands"))

    def reached(b: Column) -> Column:
        other = (b["lo"] != F.col("label")) | (b["hi"] != F.col("label"))
        return other & (b["able"] | able) & (b["far"] >= F.col("n")) & (b["least"] <= F.col("far"))

    return rows.join(bands, "s").where(F.exists("bands", reached)).drop("bands")


def pivoted(rows: DataFrame, lanes: int) -> DataFrame:
    """(s, pivots): for each shingle the first class of each lane of groups, and of lanes inside of groups when there are many."""
    lane = [F.pmod(F.hash(c, F.lit(lanes)), F.lit(m)).alias(a) for c, m, a in (("label", lanes, "lane"), ("c", max(1, lanes // 16), "inner"))]
    firsts = rows.groupBy("s", *lane).agg(F.min(F.struct("own", "c", "n", "far", "label")).alias("p"))
    return firsts.groupBy("s").agg(F.collect_list("p").alias("pivots"))


def groups(rows: DataFrame, texts: DataFrame, k: int, percent: int, chunk: int, part: int, lanes: int) -> DataFrame:
    """(c, root): the group of each class that has a link, by rounds over the prefix rows."""
    label = written(rows.select("c", "label").distinct(), "labels")
    while True:
        rows = written(pairable(rows), "rows")
        if rows.isEmpty():
            return label.withColumnRenamed("label", "root")
        met = rows.join(pivoted(rows, lanes), "s")
        is_pivot = F.array_contains(F.col("pivots.c"), F.col("c"))

        def fits(p: Column) -> Column:
            once = ~is_pivot | (F.struct(p["own"], p["c"]) < F.struct("own", "c"))
            return (p["label"] != F.col("label")) & (p["n"] <= F.col("far")) & (F.col("n") <= p["far"]) & once

        pairs = met.withColumn("p", F.explode(F.filter("pivots", fits)))
        pairs = pairs.groupBy(F.col("p.c").alias("x"), F.col("c").alias("y")).agg(F.first("p.label").alias("lx"), F.first("label").alias("ly"), F.first("n").alias("n"))
        found = written(links(written(pairs, "pairs"), texts, k, percent, chunk, part), "links")
        rest = met.where(~is_pivot).drop("pivots")
        if not found.isEmpty():
            joined = written(components(found.select(F.col("lx").alias("x"), F.col("ly").alias("y"))), "joined")
            root = F.coalesce("root", "label").alias("label")
            named = joined.withColumnRenamed("node", "label")
            rest = rest.join(named, "label", "left").select("s", "c", "n", "far", "own", root)
            label = written(label.join(named, "label", "left").select("c", root), "labels")
        rows, lanes = rest, lanes * 4


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, screen: int = SCREEN, chunk: int = CHUNK, part: int = PART, lanes: int = LANES) -> DataFrame:
    """(id, a, b, key, n_shingles, group, component_id): one row for each input row; `group` is null for texts without words."""
    docs = keyed(df, id_col, text_col)
    kind = dict(df.dtypes)[id_col]
    rows = written(docs.mapInArrow(_class_rows(k), f"id {kind}, a long, b int, key string, d binary, c long, n long"), "classes")
    classes = written(rows.where("n > 0").groupBy("d").agg(F.min("c").alias("c"), F.min("n").alias("n"), F.min(F.struct("id", "a", "b", "key")).alias("rep"), F.min("id").alias("least")), "class")
    texts = candidates(docs, screened(docs, classes, k, percent, screen, chunk))
    labels = groups(written(prefixes(texts, k, percent), "prefixes"), texts, k, percent, chunk, part, lanes)
    named = classes.join(labels, "c", "left").select("d", F.coalesce("root", "c").alias("group"), "least")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(least, "group").select("d", "group", "component_id")
    out = rows.join(named, "d", "left")
    return out.select("id", "a", "b", "key", F.col("n").alias("n_shingles"), "group", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each group of linked texts, that of the least id; rows without words all stay."""
    rows = written(grouped(docs, id_col, text_col, **options), "groups")
    keep = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "a", "b", "key")).alias("k")).select("k.key")
    cased = docs.select(F.struct(*docs.columns).alias("doc"))  # so no column can clash
    cased = cased.withColumn("key", row_key(F.col("doc")[id_col], F.col("doc")[text_col]))
    first = Window.partitionBy("key").orderBy(F.lit(0))
    found = cased.join(keep, "key", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc.*")
    wordless = docs.where(~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return found.unionByName(wordless)
