"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become integers; each distinct integer vector stands once in the fit list. Per dimension, the list's exact
sums centre its rows. Blockwise TSQR compresses the centred rows: every task folds its blocks into one triangular
factor, factors meet in `LANES` tasks and then in one. Plane rotations orthogonalise the columns of the last factor R;
the accumulated rotations are the components, and the lengths of the rotated columns give accurate standard
deviations (no covariance matrix is formed, so small ones keep their digits). A second pass over the list measures how
far the whitened rows' covariance is from the identity.

Shuffled are the integer vectors, once, with copies removed in each task first. What comes to the driver are sums, the
components and the measured covariance: at most `dim` times 16 numbers each for every length of vectors.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out; repeated rows are rows
of their own, whatever their ids. Vectors of each length are a fit of their own; a vector without entries has no
component and so no row. With fewer dimensions than 16 there are as many components. A component without variance
(its standard deviation is below 1e-12 of the first) has `whitened` null and takes no part in `identity_error`, which is null if
no component is left, as `explained` is if nothing varies. Components of equal eigenvalue are any basis of their space.
`deviation` is null where it doesn't fit a long. An entry of 2**40 / 64 or more is an error. Texts and further columns aren't looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from palletry.llm.common import slices, written
from palletry.llm.drake_clusters import finite, floored

SCALE, SHIFT, COMPONENTS, LANES, LIMIT = 64, 1_000_000, 16, 32, 1 << 40
NO_VARIANCE = 1e-12


def rotated(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (as columns) of a matrix by one-sided Jacobi rotations.

    A sweep meets all pairs of columns; disjoint pairs turn together. It ends when all columns are orthogonal.
    """
    d = r.shape[1]
    even = d + d % 2
    a = np.zeros((len(r), even))
    a[:, :d] = r
    v, seats, tiny = np.eye(even), np.arange(even), even * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = seats[: even // 2], seats[even // 2 :][::-1]
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
            left, right = a[:, p], a[:, q]
            pp, qq, pq = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            live = np.abs(pq) > tiny * np.sqrt(pp * qq)
            if not live.any():
                continue
            turned = True
            zeta = (qq - pp) / np.where(live, 2 * pq, 1)
            t = np.where(live, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    size = np.sqrt((a[:, :] ** 2).sum(0))
    order = [i for i in np.argsort(-size, kind="stable") if np.abs(v[:d, i]).any()][:d]
    return size[order], v[:d, order]


def _wide(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a list column, for each length of its lists."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and sizes.min() == sizes.max():
        parts = [(int(sizes[0]), np.arange(len(sizes)))]
    else:
        parts = [(int(k), np.flatnonzero(sizes == k)) for k in np.unique(sizes)]
    for k, rows in parts:
        if k:
            yield k, rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, k)


def _scaled_gap(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly, as longs or, if they might not fit, as Python's integers."""
    fits = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) < 1 << 62
    return n * x - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _scaled_gap(x, n, sums).astype(np.float64) / n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, rows, x in _wide(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([x.sum(0)], pa.list_(pa.int64()))], ["dim", "n", "sums"])


def _factors(fits: dict[int, tuple[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            for k, _, x in _wide(b.column(0)):
                block = _centred(x, *fits[k])
                kept[k] = np.linalg.qr(np.vstack([kept[k], block]) if k in kept else block, mode="r")
        lane = TaskContext.get().partitionId() % LANES
        for k, r in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([r.reshape(-1)], pa.list_(pa.float64()))], ["dim", "lane", "r"])

    return run


def _folded(p: pd.DataFrame) -> np.ndarray:
    """The triangular factor of all factors of a group, one after the other."""
    k, out = int(p.dim.iloc[0]), None
    for r in p.r:
        block = np.asarray(r).reshape(-1, k)
        out = block if out is None else np.linalg.qr(np.vstack([out, block]), mode="r")
    return out


def _joined_factors(p: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": p.dim.iloc[:1], "lane": p.lane.iloc[:1], "r": [_folded(p).reshape(-1)]})


def _components(most: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        size, v = rotated(_folded(p))
        return pd.DataFrame({"dim": p.dim.iloc[:1], "size": [size], "v": [v[:, :most].T.reshape(-1)]})

    return run


class Fit:
    """The fit of one length of vectors: count, sums, components (columns), standard deviations and shares of the variance."""

    def __init__(self, dim: int, n: int, sums: list[int], size: np.ndarray, v: np.ndarray):
        self.dim, self.n, self.sums, self.identity_error = dim, n, sums, None
        m, total = len(v) // dim, float((size * size).sum())
        self.v, self.sd = v.reshape(m, dim).T, size[:m] / np.sqrt(n)
        self.explained = size[:m] ** 2 / total if total > 0 else np.full(m, np.nan)
        self.live = size[:m] > size.max() * NO_VARIANCE

    def whitened(self, x: np.ndarray) -> np.ndarray:
        w = np.full((len(x), len(self.sd)), np.nan)
        w[:, self.live] = _centred(x, self.n, self.sums) @ self.v[:, self.live] / self.sd[self.live]
        return w

    def deviation(self, x: np.ndarray) -> list:
        gap = _scaled_gap(x, self.n, self.sums)
        if gap.dtype != object and self.dim * float(np.abs(gap).max(initial=0)) ** 2 >= 2.0**62:
            gap = gap.astype(object)
        total = (gap * gap).sum(1).tolist()
        return [t if t < 1 << 63 else None for t in total]


def _moments(fits: dict[int, Fit]):
    """Per task and length: count, sums and products of the whitened rows, as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            for k, _, x in _wide(b.column(0)):
                w = fits[k].whitened(x)[:, fits[k].live]
                kept[k] = kept.get(k, 0) + np.r_[w.sum(0), (w.T @ w).reshape(-1)]
        for k, m in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m], pa.list_(pa.float64()))], ["dim", "m"])

    return run


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors over a table of distinct integer vectors `x`."""
    each = F.posexplode("sums").alias("at", "s")
    parts = vectors.mapInArrow(_sums, "dim int, n long, sums array<long>")
    totals = parts.select("dim", "n", each).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in totals.collect():  # one row a dimension
        found.setdefault(r.dim, {})[r["at"]] = (r.n, int(r.s))
    sums = {k: (t[0][0], [t[i][1] for i in range(k)]) for k, t in found.items()}
    lanes = vectors.mapInArrow(_factors(sums), "dim int, lane int, r array<double>").groupBy("dim", "lane").applyInPandas(_joined_factors, "dim int, lane int, r array<double>")
    models = lanes.groupBy("dim").applyInPandas(_components(components), "dim int, size array<double>, v array<double>").collect()
    fits = {r.dim: Fit(r.dim, *sums[r.dim], np.array(r["size"]), np.array(r.v)) for r in models}
    moments = vectors.mapInArrow(_moments(fits), "dim int, m array<double>").select("dim", F.posexplode("m").alias("at", "m"))
    sized: dict[int, dict[int, float]] = {}
    for r in moments.groupBy("dim", "at").agg(F.sum("m").alias("m")).collect():  # 16 * 17 rows a length
        sized.setdefault(r.dim, {})[r["at"]] = r.m
    for k, m in sized.items():
        live = int(fits[k].live.sum())
        mean = np.array([m[i] for i in range(live)]) / fits[k].n
        products = np.array([m[live + i] for i in range(live * live)]).reshape(live, live) / fits[k].n
        fits[k].identity_error = float(np.abs(products - np.outer(mean, mean) - np.eye(live)).max())
    return fits


def whitened(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    v = F.col(vector_col)
    rows = df.where(finite(v)).select(F.col(id_col).alias("id"), F.transform(floored(v, scale, LIMIT), lambda c: c + shift).alias("x"))
    kind = dict(rows.dtypes)["id"]
    fits = fitted(written(rows.select("x").where(F.size("x") > 0).distinct(), "fit-list"), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            for k, where, x in _wide(b.column(1)):
                f = fits[k]
                m = len(f.sd)
                number = lambda a: pa.array(a, pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(where, m))),
                        pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                        pa.array(np.full(m * len(x), f.n), pa.int64()),
                        pa.array(f.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), m))),
                        number(f.whitened(x).reshape(-1)),
                        number(np.tile(f.explained, len(x))),
                        pa.array([f.identity_error] * (m * len(x)), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
