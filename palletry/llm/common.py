"""What the operators of this subpackage share: written intermediate tables and word hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only where the setting is absent and the master is local (tests) a local folder stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palletry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_TABLES: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _tidy() -> None:
    """At the end of the process the tables it wrote go, if the session still lives; results read from them must not."""
    for spark, path in _TABLES:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palletry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, before: DataFrame | None) -> DataFrame:
    """`written`, for rounds: the round's own table, `before`, goes once the new one is complete."""
    out = written(df, name)
    out._round_path = _TABLES[-1][1]
    if before is not None:
        _delete(df.sparkSession, before._round_path)
        _TABLES.remove((df.sparkSession, before._round_path))
    return out


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over 64-bit values (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of the hash base and of its inverse modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
        _INVERSES = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)])
    return _POWERS[:n], _INVERSES[:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j]-P[i] = sum of table[b[k]] * base**k for i <= k < j."""
    p, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, inv = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words `[^\\x20\\x09-\\x0D]+`; separators are ASCII, so UTF-8 bytes serve."""
    gap = np.r_[True, _SPACE[b], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, A-Z lower-cased, in order."""
    b = _LOWER[np.frombuffer(text, np.uint8)]
    start, end = word_spans(b)
    return span_hash(prefix_hash(b), start, end)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; fewer words make one shingle, none make none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mixed(h + w[i : len(w) - k + 1 + i] + np.uint64(k))
    return np.unique(h)


def shingle_sets(texts: list[bytes], k: int, slice_bytes: int = 500_000):
    """`shingle_set` of each text in turn; hashes are computed for slices of texts together."""
    at = 0
    while at < len(texts):
        part, total = [], 0
        while at < len(texts) and (not part or total + len(texts[at]) < slice_bytes):
            part.append(texts[at])
            total += len(texts[at])
            at += 1
        size = np.fromiter(map(len, part), np.int64, len(part))
        b = _LOWER[np.frombuffer(b"\n".join(part), np.uint8)]
        start, end = word_spans(b)
        w = span_hash(prefix_hash(b), start, end)
        edge = np.searchsorted(start, np.r_[0, np.cumsum(size + 1)])
        n = max(0, len(w) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k if n else 0):
            h = mixed(h + w[i : n + i] + np.uint64(k))
        for t, lo, hi in zip(part, edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < k:
                yield shingle_set(t, k)
            else:
                own = np.sort(h[lo : hi - k + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]


def bit_map(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits as 64-bit words, set at a column's values modulo their number; fixed size, whatever the rows."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = df.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks


def is_marked(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.uint64) & np.uint64(len(marks) * 64 - 1)
    return (marks[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def slices(batches, rows: int = 1000):
    """Arrow batches cut into small ones, so that only few rows at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def parted(texts: list[bytes], size: int = 500_000):
    """Lists of texts of some `size` bytes together, in order, for work whose memory is many times that of the texts; a longer text stands alone."""
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > size:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def row_key(id_value: Column, text: Column) -> Column:
    """One key column, never null, for a row's id and text: joins and windows on it share a shuffle."""
    return F.md5(F.concat_ws(":", F.coalesce(id_value.cast("string"), F.lit("none")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
