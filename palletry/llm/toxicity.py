"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a vector of the word itself (if the vocabulary of the training rows has it) and the mean vector of
its character trigrams (hashed). Both vectors start at random. Texts are cut into overlapping windows of `WINDOW` words,
`STRIDE` apart, all of which are scored; a text's score is that of its worst window.

Training happens on the driver with at most `TRAIN_ROWS` labelled rows, the first by a hash of the id among those whose
crc32(id) mod 5 is not 0, with all windows of each. The first turn draws a window of a text anew in each step; after each
turn all windows are scored and the next one takes the worst of each text. The recurrent part is fitted by Adam. Word and
trigram vectors step by their gradient over the largest one of their table, so that names of few texts, which would be
learned by heart, move little; they decay, and either half of a word's input is left out at random. A last step puts the
best cut of these texts' scores at 0.5. Only the number of rows is bounded: the driver holds the whole texts of these
rows, and its time grows with their length. Scoring maps over the documents: the network, of fixed size, is broadcast,
and no rows move.

Defined results: null, empty and blank texts have one empty window; without training rows of both labels each score is
the share of toxic ones (0 without any); repeated labels count as toxic if one does; of the texts of a repeated id the
least one is trained on; null ids are scored, never trained on; texts of any length are scored whole; repeated rows get equal
scores; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palletry.llm.common import mixed, slices

WINDOW, STRIDE, HIDDEN, WORD_SIZE, CHAR_SIZE, ATTENTION = 64, 48, 8, 8, 8, 8
VOCABULARY, TRIGRAMS, TRAIN_ROWS = 50_000, 1 << 13, 4_000
ROUNDS, FIRST_STEPS, STEPS, BATCH, RATE, DECAY = 5, 150, 50, 192, 0.01, 0.01
START, TABLE_RATE, TABLE_DECAY, DROPOUT = 0.1, 0.1, 0.005, 0.4
CACHED_WORDS, SLICE_WINDOWS = 80_000, 1024
EDGES = ".,;:!?|\"'`´()[]{}<>*&$%#@~^=+-_/\\…“”„«»¡¿"


def windows(n: int) -> list[tuple[int, int]]:
    """Word spans of a text's windows; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def canonical(token: str) -> str:
    return token.strip(EDGES) or token


def trigram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of `^word$` for some words, flat, and how many each has."""
    raw = [f"^{w or ' '}$".encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint64)
    h = mixed(b[:-2] * np.uint64(65536) + b[1:-1] * np.uint64(256) + b[2:]) % np.uint64(TRIGRAMS)
    end = np.cumsum(size)
    keep = np.ones(len(h), bool)
    keep[end - 1] = False
    keep[end - 2] = False
    return h[keep].astype(np.int64), size - 2


def glorot(rng, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * math.sqrt(2.0 / (shape[0] + shape[-1]))).astype(np.float32)


class Network:
    """Parameters, forward pass with memory for training, and gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        self.vocabulary, self.shift = vocabulary, 0.0
        self.p = {
            "word": (rng.standard_normal((len(vocabulary) + 1, WORD_SIZE)) * START).astype(np.float32),
            "char": (rng.standard_normal((TRIGRAMS, CHAR_SIZE)) * START).astype(np.float32),
            "attend": glorot(rng, 2 * h, ATTENTION),
            "attend_b": np.zeros(ATTENTION, np.float32),
            "attend_v": glorot(rng, ATTENTION, 1)[:, 0],
            "out": glorot(rng, 2 * h, 1)[:, 0],
            "out_b": np.array([-1.0], np.float32),
        }
        self.p["word"][-1] = 0
        for d in "fb":
            self.p |= {f"w{d}": glorot(rng, size, 3 * h), f"u{d}": glorot(rng, h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors, with the rows they were made of (vocabulary rows, trigrams, trigram counts)."""
        rows = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], np.int64)
        grams, count = trigram_rows(words)
        total = np.add.reduceat(self.p["char"][grams], np.cumsum(count) - count, 0) / count[:, None]
        return np.concatenate([self.p["word"][rows], total.astype(np.float32)], 1), rows, grams, count

    def _direction(self, d: str, g: np.ndarray, live: np.ndarray, memory: list | None) -> np.ndarray:
        """States of one direction over (time, batch, 3h) inputs; `live` (time, batch) marks real words."""
        h = HIDDEN
        u = self.p[f"u{d}"]
        steps, batch = g.shape[:2]
        out = np.empty((steps, batch, h), np.float32)
        state = np.zeros((batch, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = state @ u
            gates = 0.5 * np.tanh(0.5 * (g[t, :, : 2 * h] + hu[:, : 2 * h])) + 0.5
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(g[t, :, 2 * h :] + r * hu[:, 2 * h :])
            fresh = n + z * (state - n)
            on = live[t, :, None]
            if memory is not None:
                memory.append((t, state, z, r, n, hu[:, 2 * h :], on))
            state = np.where(on, fresh, state)
            out[t] = state
        return out

    def _pooled(self, states: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        u = np.tanh(states @ p["attend"] + p["attend_b"])
        e = np.where(live, u @ p["attend_v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = np.where(live, e, 0)
        alpha /= np.maximum(alpha.sum(0), 1e-9)
        pooled = (alpha[:, :, None] * states).sum(0)
        return u, alpha, pooled, pooled @ p["out"] + p["out_b"][0]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], 1)

    def halved(self, table: np.ndarray) -> np.ndarray:
        """Projected inputs with those of the two sigmoid gates halved, as sigmoid(x) = (tanh(x/2) + 1) / 2."""
        scale = np.ones(6 * HIDDEN, np.float32)
        scale[: 2 * HIDDEN] = scale[3 * HIDDEN : 5 * HIDDEN] = 0.5
        return table * scale

    def logits(self, table: np.ndarray, index: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Window logits from a halved table; the same network as in training, laid out (time, unit, window)."""
        p, h = self.p, HIDDEN
        steps, batch = index.shape
        whole = bool(live.all())
        states = np.empty((steps, 2 * h, batch), np.float32)
        gates, n, change = np.empty((2 * h, batch), np.float32), np.empty((h, batch), np.float32), np.empty((h, batch), np.float32)
        mixed_in = np.empty((3 * h, batch), np.float32)
        for i, d in enumerate("fb"):
            g = np.ascontiguousarray(table[:, i * 3 * h : (i + 1) * 3 * h][index].transpose(0, 2, 1))
            u = p[f"u{d}"].T.astype(np.float32).copy()
            u[: 2 * h] *= 0.5
            state = np.zeros((h, batch), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.matmul(u, state, out=mixed_in)
                np.add(g[t, : 2 * h], mixed_in[: 2 * h], out=gates)
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                np.multiply(gates[h:], mixed_in[2 * h :], out=n)
                n += g[t, 2 * h :]
                np.tanh(n, out=n)
                np.subtract(state, n, out=change)
                change *= gates[:h]
                fresh = states[t, i * h : (i + 1) * h]
                np.add(n, change, out=fresh)
                if not whole:
                    np.copyto(fresh, state, where=~live[t])
                state = fresh
        seen = np.matmul(p["attend"].T.astype(np.float32).copy(), states)
        seen += p["attend_b"][:, None]
        np.tanh(seen, out=seen)
        e = np.matmul(p["attend_v"].astype(np.float32), seen)
        e = np.where(live, e, -1e9)
        e = np.where(live, np.exp(e - e.max(0)), 0)
        said = np.matmul(p["out"].astype(np.float32), states)
        return (e * said).sum(0) / np.maximum(e.sum(0), 1e-9) + p["out_b"][0]

    def gradients(self, words: list[str], index: np.ndarray, live: np.ndarray, labels: np.ndarray, weight: np.ndarray, keep: np.ndarray | None = None) -> dict:
        """Gradients of the weighted logistic loss; `index` (time, batch) points into `words`, all distinct, whose inputs `keep` multiplies."""
        p, h = self.p, HIDDEN
        x, rows, grams, count = self.inputs(words)
        if keep is not None:
            x = x * keep
        table = self.projected(x)
        memory = {"f": [], "b": []}
        g = table[index]
        both = [self._direction(d, g[:, :, i * 3 * h : (i + 1) * 3 * h], live, memory[d]) for i, d in enumerate("fb")]
        states = np.concatenate(both, 2)
        u, alpha, pooled, logit = self._pooled(states, live)
        d_logit = (weight * (1 / (1 + np.exp(-logit)) - labels) / weight.sum()).astype(np.float32)
        grad = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_alpha = (states * d_pooled).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        grad["attend_v"] = (u * d_e[:, :, None]).sum((0, 1))
        d_u = d_e[:, :, None] * p["attend_v"] * (1 - u * u)
        grad["attend"] = np.tensordot(states, d_u, ([0, 1], [0, 1]))
        grad["attend_b"] = d_u.sum((0, 1))
        d_states = alpha[:, :, None] * d_pooled + d_u @ p["attend"].T
        d_table = np.zeros_like(table)
        for i, d in enumerate("fb"):
            d_g = np.zeros((*index.shape, 3 * h), np.float32)
            d_u_matrix = np.zeros_like(p[f"u{d}"])
            carry = np.zeros((index.shape[1], h), np.float32)
            for t, before, z, r, n, hn, on in reversed(memory[d]):
                total = carry + d_states[t, :, i * h : (i + 1) * h]
                inner = np.where(on, total, 0)
                d_n = inner * (1 - z) * (1 - n * n)
                d_z = inner * (before - n) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_g[t] = np.concatenate([d_z, d_r, d_n], 1)
                d_hu = np.concatenate([d_z, d_r, d_n * r], 1)
                d_u_matrix += before.T @ d_hu
                carry = np.where(on, inner * z, total) + d_hu @ p[f"u{d}"].T
            grad[f"u{d}"] = d_u_matrix
            for k in range(3 * h):
                d_table[:, i * 3 * h + k] = np.bincount(index.ravel(), d_g[:, :, k].ravel(), len(words))
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            part = d_table[:, i * 3 * h : (i + 1) * 3 * h]
            grad[f"w{d}"], grad[f"b{d}"] = x.T @ part, part.sum(0)
            d_x += part @ p[f"w{d}"].T
        if keep is not None:
            d_x *= keep
        grad["word"] = np.zeros_like(p["word"])
        grad["word"][rows] = d_x[:, :WORD_SIZE]  # words are distinct: only the last row, of unknown ones, stands for several
        grad["word"][-1] = 0
        each = np.repeat(d_x[:, WORD_SIZE:] / count[:, None], count, 0)
        grad["char"] = np.stack([np.bincount(grams, each[:, k], TRIGRAMS) for k in range(CHAR_SIZE)], 1).astype(np.float32)
        return grad


class Scorer:
    """Scores texts with a network; projected inputs of words are kept between slices."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def _learn(self, tokens: set[str]) -> None:
        new = list(tokens - self.known.keys())
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, new, self.table = {}, list(tokens), self.table[:1]
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            x = self.network.inputs([canonical(t) for t in new])[0]
            self.table = np.concatenate([self.table, self.network.halved(self.network.projected(x))])

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of some texts, and each text's number of windows."""
        tokens = [t.lower().split() for t in texts]
        self._learn(set().union(*tokens))
        get = self.known.__getitem__
        spans, pieces, at, counts = [], [], 0, []
        for words in tokens:
            pieces.append(np.fromiter(map(get, words), np.int64, len(words)))
            own = windows(len(words))
            spans += [(at + s, e - s) for s, e in own]
            counts.append(len(own))
            at += len(words)
        flat = np.concatenate([*pieces, np.zeros(WINDOW, np.int64)])
        start, size = np.array(spans, np.int64).reshape(-1, 2).T
        out = []
        for i in range(0, len(start), SLICE_WINDOWS):
            s, n = start[i : i + SLICE_WINDOWS], size[i : i + SLICE_WINDOWS]
            steps = np.arange(max(1, int(n.max())))[:, None]
            live = steps < n
            index = np.where(live, flat[s + steps], 0)
            out.append(self.network.logits(self.table, index, live))
        return np.concatenate(out) if out else np.zeros(0, np.float32), np.array(counts, np.int64)

    def worst(self, texts: Iterable[str]) -> Iterator[tuple[int, float]]:
        """Number and logit of each text's worst window."""
        part, total = [], 0
        for text in texts:
            part.append(text)
            total += len(text)
            if total >= 200_000:
                yield from self._worst(part)
                part, total = [], 0
        if part:
            yield from self._worst(part)

    def _worst(self, texts: list[str]) -> Iterator[tuple[int, float]]:
        logit, counts = self.window_logits(texts)
        for own in np.split(logit, np.cumsum(counts)[:-1]):
            k = int(own.argmax())
            yield k, float(own[k])

    def scores(self, texts: list[str]) -> Iterator[float]:
        worst = np.fromiter((v for _, v in self.worst(texts)), float, len(texts))
        yield from (1 / (1 + np.exp(-np.clip(worst - self.network.shift, -60, 60)))).tolist()


class Descent:
    """Steps of Adam for the recurrent part, and for the tables of words and trigrams by one scale for all their rows."""

    def __init__(self, network: Network, steps: int):
        self.p, self.steps, self.step = network.p, steps, 0
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros((), np.float32) if k in ("word", "char") else np.zeros_like(v) for k, v in self.p.items()}

    def apply(self, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = min(1.0, 2 * (1 - self.step / (self.steps + 1)))
        for k, g in grad.items():
            table = k in ("word", "char")
            slow, size, step, decay = (0.99, np.square(g).max(), TABLE_RATE, TABLE_DECAY) if table else (0.999, g * g, RATE, RATE * DECAY)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] = self.second[k] + (1 - slow) * (size - self.second[k])
            scale = np.sqrt(self.second[k] / (1 - slow**self.step)) + 1e-8
            self.p[k] -= (rate * step * self.first[k] / (1 - 0.9**self.step) / scale).astype(np.float32)
            self.p[k] *= np.float32(1 - rate * decay)


def centred(logit: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the logits between which a cut makes the fewest errors."""
    order = np.argsort(logit, kind="stable")
    y, v = labels[order], logit[order]
    errors = np.r_[0, np.cumsum(y)] + (len(y) - y.sum()) - np.r_[0, np.cumsum(1 - y)]
    best = np.flatnonzero(errors == errors.min())
    low, high = best[0], best[-1]
    return float((v[low - 1] if low else v[0] - 2) + (v[high] if high < len(y) else v[-1] + 2)) / 2


def trained(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to whole texts with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    pool: dict[str, str] = {}
    tokens = [[pool.setdefault(t, t) for t in map(canonical, x.lower().split())] for x in texts]
    found = Counter(w for t in tokens for w in set(t))
    names = sorted((w for w, n in found.items() if n > 1), key=lambda w: (-found[w], w))[:VOCABULARY]
    del found, pool
    net = Network({w: i for i, w in enumerate(names)}, seed)
    descent = Descent(net, FIRST_STEPS + (ROUNDS - 1) * STEPS)
    spans = [windows(len(t)) for t in tokens]
    worst, logit = None, np.zeros(len(tokens))
    positive, negative = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    for _ in range(ROUNDS):
        hard = negative[np.argsort(-logit[negative], kind="stable")[: max(BATCH, len(negative) // 10)]]
        for _ in range(STEPS if worst else FIRST_STEPS):
            pick = np.r_[rng.choice(positive, BATCH // 3), rng.choice(negative, BATCH // 3), rng.choice(hard, BATCH // 3)]
            own = [spans[i][worst[i] if worst else rng.integers(len(spans[i]))] for i in pick]
            batch = [tokens[i][a:b] for i, (a, b) in zip(pick, own)]
            distinct = {w: k for k, w in enumerate(dict.fromkeys(w for x in batch for w in x) or [""])}
            size = np.array([len(x) for x in batch])
            index = np.zeros((max(1, int(size.max())), len(batch)), np.int64)
            for k, x in enumerate(batch):
                index[: len(x), k] = [distinct[w] for w in x]
            live = np.arange(len(index))[:, None] < size
            keep = np.repeat((rng.random((len(distinct), 2)) >= DROPOUT).astype(np.float32), [WORD_SIZE, CHAR_SIZE], 1)
            descent.apply(net.gradients(list(distinct), index, live, labels[pick].astype(np.float32), np.ones(len(pick), np.float32), keep))
        values = list(Scorer(net).worst(" ".join(t) for t in tokens))
        worst, logit = [k for k, _ in values], np.array([v for _, v in values])
    net.shift = centred(logit, labels)
    return net


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Network | float:
    """The network for some labelled documents, or the share of toxic ones if that is all there is to learn."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    present = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    known = known.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id")
    sample = sample.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).orderBy("_id").toArrow()
    y = (sample.column("_y").to_numpy() > 0).astype(np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return trained([t or "" for t in sample.column("_text").to_pylist()], y)


def _with_scores(docs: DataFrame, model: Network | float, text_col: str) -> DataFrame:
    """(doc, score): the rows as structs. Their texts go to the tasks and back once, inside the struct, if they are strings."""
    doc = F.struct(*docs.columns).alias("doc")
    if isinstance(model, float):
        return docs.select(doc, F.lit(model).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    inside = docs.dtypes.index((text_col, "string")) if (text_col, "string") in docs.dtypes else None
    rows = docs.select(doc) if inside is not None else docs.select(doc, F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in slices(batches):
            texts = batch.column(0).field(inside) if inside is not None else batch.column(1)
            values = list(scorer.scores([t or "" for t in texts.to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """`docs` with a column `score`, 0 to 1, in place of any that has this name."""
    out = _with_scores(docs, fitted(docs, labels, id_col, text_col, label_col), text_col)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "score"], "score")


def below(docs: DataFrame, labels: DataFrame, bound: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is less than `bound`."""
    return _with_scores(docs, fitted(docs, labels, id_col, text_col, label_col), text_col).where(F.col("score") < bound).select("doc.*")
