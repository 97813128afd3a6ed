"""Many regularised linear classifiers at once, by Newton steps.

A step is one pass over the rows: every task sums loss, gradient and Hessian of every model over its rows, the sums are
added up by model, and the driver solves one small system a model. Models may see different columns, weigh the loss
differently and leave out different folds, so all folds of all trials share the passes. The driver and each task hold
(columns + 1)**2 numbers a model, whatever the number of rows.

On many rows the first steps go over some of them, to start near the end; the steps that follow go over all rows, until these
agree. Of models that differ in `c` alone one goes first then, and the others start from its sums at its end, which are theirs at
that place too. As an objective has one optimum, the start changes the number of passes only. Rows may weigh as many equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palletry.functions.numeric import sigmoid
from palletry.sources.snapshots import stored

#: Half the width of the parabola that rounds off the hinge, at first and at last.
WIDTHS = (1.0, 0.1)
RIDGE, DAMPING = 1e-9, 1e-6
#: Rows that the first steps go over, if there are twice as many or more.
START = 200_000
#: Models over at most so many columns sum up their Hessians in one product.
NARROW = 16


@dataclass(frozen=True)
class Linear:
    """A model over some columns of the row's vector: |w|**2 / 2 + c * (sum of losses); `without` leaves out a fold."""

    name: str
    loss: str = "logistic"
    c: float = 1.0
    columns: tuple[int, ...] | None = None
    without: int | None = None


def _loss(kind: str, margin: np.ndarray, y: np.ndarray, width: float = WIDTHS[-1]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss and its first two derivatives by the margin, row by row; labels are 0 to 1, for the hinge 0 or 1."""
    if kind == "logistic":
        e = np.exp(-np.abs(margin))
        p = np.where(margin < 0, e, 1) / (1 + e)
        return np.maximum(margin, 0) + np.log1p(e) - y * margin, p - y, p * (1 - p)
    if kind != "hinge":
        raise ValueError(kind)
    sign = 2 * y - 1
    short = 1 - sign * margin
    bent, straight = np.abs(short) <= width, short > width
    loss = np.where(straight, short, np.where(bent, (short + width) ** 2 / (4 * width), 0))
    slope = np.where(straight, 1, np.where(bent, (short + width) / (2 * width), 0))
    return loss, -sign * slope, np.where(bent, 1 / (2 * width), 0)


def _with_one(x: np.ndarray, m: Linear) -> np.ndarray:
    x = x if m.columns is None else x[:, m.columns]
    return np.c_[x, np.ones(len(x))]


def _sums(models: dict[int, Linear], at: dict[int, np.ndarray], width: dict[int, float], lift: Callable[[np.ndarray], np.ndarray] | None = None):
    """Sums of loss, gradient and Hessian. Models over the same columns and rows share these, and the products of columns."""
    groups: dict[tuple, list[int]] = {}
    for i, m in models.items():
        groups.setdefault((m.columns, m.without), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            x = x if lift is None else lift(x)
            y, fold, weight = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            for (_, without), own in groups.items():
                rows = fold != without if without is not None else slice(None)
                z, t, w = _with_one(x[rows], models[own[0]]), y[rows], weight[rows]
                n, heavy = z.shape[1], z * w[:, None]
                margins = z @ np.stack([at[i] for i in own], 1)
                found = [_loss(models[i].loss, margins[:, k], t, width[i]) for k, i in enumerate(own)]
                slopes = heavy.T @ np.stack([f[1] for f in found], 1)
                if n <= NARROW:
                    left, right = np.triu_indices(n)
                    products = (heavy[:, left] * z[:, right]).T @ np.stack([f[2] for f in found], 1)
                for k, i in enumerate(own):
                    if n <= NARROW:
                        h = np.zeros((n, n))
                        h[left, right] = h[right, left] = products[:, k]
                    else:
                        bent = np.flatnonzero(found[k][2])  # of a hinge few rows
                        h = (heavy[bent] * found[k][2][bent, None]).T @ z[bent]
                    total[i] = total.get(i, 0) + np.r_[w @ found[k][0], slopes[:, k], h.reshape(-1)]
        for i, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([s], pa.list_(pa.float64()))], ["model", "sums"])

    return run


class _Steps:
    """Damped Newton steps of one model; a step that raises the objective is taken back and damped more."""

    def __init__(self, model: Linear, size: int, start: np.ndarray | None = None):
        self.model, self.size = model, size
        self.widths = ([*WIDTHS] if start is None else [WIDTHS[-1]]) if model.loss == "hinge" else [0.0]
        self.best = np.zeros(size) if start is None else start
        self.value, self.move, self.damping, self.live = np.inf, np.zeros(size), DAMPING, True

    def take(self, sums: np.ndarray, tolerance: float) -> None:
        n, c, at = self.size, self.model.c, self.best + self.move
        free = np.r_[np.ones(n - 1), 0]  # the intercept isn't regularised
        value = float(at @ (free * at) / 2 + c * sums[0])
        if value > self.value + 1e-12 * abs(self.value):
            self.damping = max(10 * self.damping, 1e-3)
        else:
            self.best, self.value, self.damping, self.sums = at, value, self.damping / 10, sums
            self.gradient = free * at + c * sums[1 : n + 1]
            self.hessian = np.diag(free) + c * sums[n + 1 :].reshape(n, n)
        scale = max(float(np.diag(self.hessian).max()), 1.0)
        self.move = -np.linalg.solve(self.hessian + (self.damping + RIDGE) * scale * np.eye(n), self.gradient)
        if np.abs(self.move).max() <= (tolerance if len(self.widths) == 1 else 1e-2) * (1 + np.abs(self.best).max()):
            if len(self.widths) == 1:
                self.live = False
            else:  # on with a sharper hinge from here
                self.widths = self.widths[1:]
                self.value, self.move, self.damping = np.inf, np.zeros(n), DAMPING


def fitted(df: DataFrame, models: list[Linear], x: str = "x", label: str = "label", fold: Column | str | None = None, steps: int = 120, tolerance: float = 1e-9, lift: Callable[[np.ndarray], np.ndarray] | None = None, n: str | None = None) -> list[np.ndarray]:
    """Weights and, last, the intercept of each model over rows with a vector and a label; nulls are errors.

    The hinge is rounded off by a parabola, a wide one at first. `df` is read once a step, so it should be a stored table. `lift` turns
    a matrix of vectors into that of the columns that models see, in the task. `n` names a column with the equal rows that a row stands for.
    """
    weight = F.lit(1.0) if n is None else F.col(n).cast("double")
    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.coalesce(F.col(fold) if isinstance(fold, str) else fold, F.lit(-1)).cast("int") if fold is not None else F.lit(-1)).alias("f"), weight.alias("w"))
    size = rows.agg(F.max(F.size("x")).alias("width"), F.count("*").alias("n"), F.sum("w").alias("w")).first()
    width = size.width or 0
    if lift is not None and width:
        width = lift(np.zeros((1, width))).shape[1]
    sizes = [1 + (width if m.columns is None else len(m.columns)) for m in models]
    state = [_Steps(m, d) for m, d in zip(models, sizes)]
    if size.n < 2 * START:
        return _taken(rows, state, steps, tolerance, lift)
    alike: dict[tuple, list[int]] = {}
    for i, m in enumerate(models):
        alike.setdefault((m.loss, m.columns, m.without), []).append(i)
    first = [sorted(own, key=lambda i: models[i].c)[len(own) // 2] for own in alike.values()]
    some = stored(rows.sample(START / size.n, seed=1), "start")
    scale = size.w / max(some.agg(F.sum("w").alias("w")).first().w or 0.0, 1.0)
    starts = _taken(some, [_Steps(replace(models[i], c=models[i].c * scale), sizes[i]) for i in first], steps, 1e-4, lift)
    for i, start in zip(first, starts):
        state[i] = _Steps(models[i], sizes[i], start)
    _taken(rows, [state[i] for i in first], steps, tolerance, lift)
    others = []
    for lead, own in zip(first, alike.values()):
        for i in own:
            if i != lead:
                state[i] = _Steps(models[i], sizes[i], state[lead].best)
                others.append(state[i])
                if not state[lead].live:
                    state[i].take(state[lead].sums, tolerance)
    _taken(rows, others, steps, tolerance, lift)
    return [s.best for s in state]


def _taken(rows: DataFrame, state: list[_Steps], steps: int, tolerance: float, lift) -> list[np.ndarray]:
    for _ in range(steps):
        live = {i: s for i, s in enumerate(state) if s.live}
        if not live:
            break
        run = _sums({i: s.model for i, s in live.items()}, {i: s.best + s.move for i, s in live.items()}, {i: s.widths[0] for i, s in live.items()}, lift)
        sums = rows.mapInArrow(run, "model int, sums array<double>")
        parts: dict[int, dict[int, float]] = {}
        for r in sums.select("model", F.posexplode("sums").alias("at", "s")).groupBy("model", "at").agg(F.sum("s").alias("s")).collect():
            parts.setdefault(r.model, {})[r["at"]] = r.s
        for i, s in live.items():
            n = 1 + s.size + s.size**2
            s.take(np.array([parts[i][j] for j in range(n)]) if i in parts else np.zeros(n), tolerance)
    return [s.best for s in state]


def scored(df: DataFrame, models: list[Linear], weights: list[np.ndarray], keep: list[str], x: str = "x", fold: str | None = None, lift: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """`keep`, and for each name of models a column with the sigmoid of the margin.

    Of models with one name, each scores the fold it left out, and one that left out none scores rows without a fold (or
    all, if it is the only one).
    """
    names = list(dict.fromkeys(m.name for m in models))
    groups: dict[tuple, list[int]] = {}
    for i, m in enumerate(models):
        alone = sum(o.name == m.name for o in models) == 1
        groups.setdefault((m.columns, None if alone else -1 if m.without is None else m.without), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(len(keep)).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            vectors = vectors if lift is None or not b.num_rows else lift(vectors)
            own = b.column(len(keep) + 1).to_numpy()
            columns = {n: np.full(b.num_rows, np.nan) for n in names}
            for (_, of), same in groups.items():
                rows = slice(None) if of is None else np.flatnonzero(own == of)
                z = _with_one(vectors[rows], models[same[0]])
                margins = z @ np.stack([weights[i] for i in same], 1) if len(z) else np.zeros((0, len(same)))
                found = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
                for k, i in enumerate(same):
                    columns[models[i].name][rows] = found[:, k]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *[pa.array(columns[n], pa.float64(), from_pandas=True) for n in names]], [*keep, *names])

    kinds = dict(df.dtypes)
    rows = df.select(*keep, F.col(x).cast("array<double>").alias("_x"), F.coalesce(F.col(fold), F.lit(-1)).cast("int") if fold else F.lit(-1))
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` double" for n in names]))


def calibrated(df: DataFrame, decision: str, label: str, steps: int = 50, tolerance: float = 1e-10) -> tuple[float, float]:
    """(slope, intercept) of P(label = 1) = sigmoid(slope * decision + intercept), by Newton steps over one aggregated row each.

    Targets are (n1 + 1) / (n1 + 2) for positive rows and 1 / (n0 + 2) for others, so separable labels have a solution too.
    A step that raises the loss is halved. Rows with a null are left out; without rows both are 0.
    """
    d, y = F.col(decision).cast("double"), F.col(label).cast("long")
    rows = df.select(d.alias("d"), y.alias("y")).where(F.col("d").isNotNull() & F.col("y").isNotNull())
    counts = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("n1"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("n0")).first()
    if counts.n1 + counts.n0 == 0:
        return 0.0, 0.0
    target = F.when(F.col("y") > 0, (counts.n1 + 1.0) / (counts.n1 + 2.0)).otherwise(1.0 / (counts.n0 + 2.0))
    at, move, value = np.array([0.0, float(np.log((counts.n1 + 1) / (counts.n0 + 1)))]), np.zeros(2), np.inf
    for _ in range(steps):
        a, b = (at + move).tolist()
        margin = F.lit(a) * F.col("d") + F.lit(b)
        p = sigmoid(margin)
        gap, bend = p - target, p * (1 - p)
        loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - target * margin
        r = rows.agg(F.sum(loss).alias("loss"), F.sum(gap * F.col("d")).alias("ga"), F.sum(gap).alias("gb"), F.sum(bend * F.col("d") * F.col("d")).alias("aa"), F.sum(bend * F.col("d")).alias("ab"), F.sum(bend).alias("bb")).first()
        if r.loss > value + 1e-12 * abs(value):
            move = move / 2
            continue
        at, value = np.array([a, b]), r.loss
        move = -np.linalg.lstsq(np.array([[r.aa, r.ab], [r.ab, r.bb]]), np.array([r.ga, r.gb]), rcond=None)[0]
        if np.abs(move).max() <= tolerance * (1 + np.abs(at).max()):
            break
    return float(at[0]), float(at[1])
