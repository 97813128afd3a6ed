"""BPE encoding and decoding with a compiled word lexicon.

Tokenizer: byte-level BPE whose words end in a suffix, as read from a `tokenizers` JSON file (NFC, white space runs to
one space, lower case; the word pattern and the vocabulary come from the file). Frequent words of the corpus are
encoded once on the driver and compiled into a minimal acyclic transducer: states with the same continuations are
shared, and the numbers on the arcs add up to a word's index in a flat table of ids. Its bytes, of bounded size, are
broadcast; each worker, also one that joins later, memory-maps them from an unnamed file of its own. Pieces of a slice
of documents walk the automaton together. Words it doesn't hold are merged exactly by rank.

The lexicon changes speed, not results. It holds at most `LEXICON_WORDS` words; the counts behind it cover all texts
(a word may be counted short by one in each chunk of a partition, where it occurred once).

Defined results: null text is the empty text, which has no tokens and decodes to the empty text; special tokens'
strings in a text are special tokens, as in the library; ids without vocabulary entry can't occur. Repeated rows are
rows of their own, any id is passed through, an empty table gives an empty result, further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from palletry.llm.common import parted, prefix_hash, slices, span_hash

LEXICON_WORDS, CACHED_CHUNKS, SLICE, SHORT, COUNTED_WORDS = 131_072, 100_000, 256, 48, 150_000
NONE = np.int64(1 << 40)
MARKS = frozenset(".,;:!?")
#: White space for `str.split`, but not for the tokenizer's pattern.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Model:
    """Vocabulary, merges and text rules of a tokenizer file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        bpe = spec["model"]
        self.vocab: dict[str, int] = dict(bpe["vocab"])
        self.end = bpe["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        chars = byte_chars()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in chars], np.int64)
        pairs = sorted((a * len(self.tokens) + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_ids = np.array(pairs or [(-1, 0, 0)], np.int64).T.copy()
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(words["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (or NONE) and results of merging neighbours."""
        key = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE), self.pair_ids[at]

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces: the pair of least rank merges first, leftmost among equals; all short pieces a round together."""
        out, short, ids, ends = self._merged(words)
        ids = ids.tolist()
        for i, lo, hi in zip(short, [0, *ends], ends):
            out[i] = tuple(ids[lo:hi])
        return out

    def merged_bytes(self, words: list[bytes]) -> list[bytes]:
        """The same as little-endian 32-bit numbers."""
        out, short, ids, ends = self._merged(words)
        out = [w if w is None else np.array(w, "<u4").tobytes() for w in out]
        raw, ends = ids.astype("<u4").tobytes(), [4 * e for e in ends]
        for i, lo, hi in zip(short, [0, *ends], ends):
            out[i] = raw[lo:hi]
        return out

    def _merged(self, words: list[bytes]) -> tuple[list, list[int], np.ndarray, list[int]]:
        """Ids of the long pieces, with None for the others, whose numbers, ids one after the other and ends of ids follow."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for i in set(range(len(words))).difference(short):
            out[i] = self._merged_long(words[i])
        if not short:
            return out, [], np.zeros(0, np.int64), []
        size = np.array([len(words[i]) for i in short])
        raw = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(short)), size)
        rank, result = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
        rank[:-1], result[:-1] = self._pairs(ids[:-1], ids[1:])
        rank[ends] = NONE
        live = np.ones(len(short), bool)
        done_ids, done_owner = [], []
        while len(ids):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, start)
            over = least == NONE
            if over.any():
                live[owner[start[over]]] = False
                stay = live[owner]
                done_ids.append(ids[~stay])
                done_owner.append(owner[~stay])
                ids, owner, rank, result = ids[stay], owner[stay], rank[stay], result[stay]
                if not len(ids):
                    break
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                least = least[~over]
            hits = np.flatnonzero(rank == np.repeat(least, np.diff(np.r_[start, len(ids)])))
            at = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            ids[at] = result[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank, result = ids[keep], owner[keep], rank[keep], result[keep]
            at -= np.arange(len(at))
            for k in (at, at[at > 0] - 1):
                k = k[k + 1 < len(ids)]
                rank[k], result[k] = self._pairs(ids[k], ids[k + 1])
                rank[k[owner[k] != owner[k + 1]]] = NONE
            rank[-1] = NONE
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return out, short, ids[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(short))).tolist()

    def _merged_long(self, word: bytes) -> tuple[int, ...]:
        """The same for one long piece, with a heap of pairs over a linked list."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.merges[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(rank, k, new) for rank, new, k in heap]
        heapq.heapify(heap)
        while heap:
            rank, k, new = heapq.heappop(heap)
            n = after[k]
            if ids[k] < 0 or n >= len(ids) or self.merges.get((ids[k], ids[n])) != (rank, new):
                continue
            ids[k], ids[n], after[k] = new, -1, after[n]
            if after[k] < len(ids):
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < len(ids) and (pair := self.merges.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (pair[0], left, pair[1]))
        return tuple(i for i in ids if i >= 0)

    def normal(self, text: str) -> str:
        """NFC and lower case character by character (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class Lexicon:
    """A minimal acyclic transducer from words to id lists, as flat arrays in one memory-mapped file."""

    NAMES = ("arc_key", "arc_to", "arc_out", "final", "offset", "ids")

    @staticmethod
    def compiled(entries: dict[bytes, tuple[int, ...]]) -> bytes:
        """Add words in order; a branch that no later word can extend is replaced by its equal, if one exists."""
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = [{}]
        final, free = [False], []
        spine: list[tuple[int, int, int]] = []  # (state, byte, next state) along the last word

        def close(depth: int) -> None:
            while len(spine) > depth:
                state, byte, to = spine.pop()
                twin = register.setdefault((final[to], tuple(arcs[to].items())), to)
                arcs[state][byte] = twin
                if twin != to:
                    arcs[to] = {}
                    free.append(to)

        before = b""
        for word in sorted(entries):
            shared = len(os.path.commonprefix([before, word]))
            close(shared)
            state = spine[-1][2] if spine else 0
            for byte in word[shared:]:
                if free:
                    new = free.pop()
                    final[new] = False
                else:
                    new = len(arcs)
                    arcs.append({})
                    final.append(False)
                arcs[state][byte] = new
                spine.append((state, byte, new))
                state = new
            final[state] = True
            before = word
        close(0)
        number: dict[int, int] = {0: 0}
        order = [0]
        for s in order:  # grows while states are found
            for to in arcs[s].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            open_ = [t for t in arcs[s].values() if t not in below]
            if open_:
                stack += open_
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                stack.pop()
        keys, to, out = [], [], []
        for s in order:
            passed = int(final[s])
            for byte in sorted(arcs[s]):
                keys.append(number[s] * 256 + byte)
                to.append(number[arcs[s][byte]])
                out.append(passed)
                passed += below[arcs[s][byte]]
        lists = [entries[w] for w in sorted(entries)]
        parts = {
            "arc_key": np.array(keys, np.int64),
            "arc_to": np.array(to, np.int32),
            "arc_out": np.array(out, np.int32),
            "final": np.array([final[s] for s in order], np.uint8),
            "offset": np.cumsum([0, *map(len, lists)]).astype(np.int32),
            "ids": np.array([i for x in lists for i in x], np.int32),
        }
        head = np.array([len(parts[n]) for n in Lexicon.NAMES], np.int64).tobytes()
        return head + b"".join(parts[n].tobytes() + b"\0" * (-parts[n].nbytes % 8) for n in Lexicon.NAMES)

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:  # unnamed; the mapping outlives it
            f.write(compiled)
            f.flush()
            raw = np.asarray(np.memmap(f, np.uint8, "r"))
        at = 8 * len(self.NAMES)
        for n, size, kind in zip(self.NAMES, raw[:at].view(np.int64), ("<i8", "<i4", "<i4", "u1", "<i4", "<i4")):
            width = int(size) * np.dtype(kind).itemsize
            setattr(self, n, raw[at : at + width].view(kind))
            at += width + -width % 8

    def lookup(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Walks all words together, byte by byte; None for those that are not in the lexicon."""
        if not words or not len(self.arc_key):
            return [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, index, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for depth in range(int(size.max())):
            alive = alive[size[alive] > depth]
            key = state[alive] * 256 + flat[start[alive] + depth]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.arc_to[arc]
            index[alive] += self.arc_out[arc]
        known = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        row = index[known]
        begin = self.offset[row].astype(np.int64)
        count = self.offset[row + 1] - begin
        bounds = np.cumsum(count)
        ids = self.ids[np.repeat(begin - bounds + count, count) + np.arange(bounds[-1] if len(bounds) else 0)].tolist()
        out: list = [None] * len(words)
        for i, lo, hi in zip(np.flatnonzero(known).tolist(), [0, *bounds.tolist()], bounds.tolist()):
            out[i] = tuple(ids[lo:hi])
        return out


class Encoder:
    """Encodes slices of texts; chunks between white space are cached, as pieces never reach across it."""

    def __init__(self, model: Model, lexicon: Lexicon | None):
        self.model, self.lexicon, self.cache = model, lexicon, {}

    def _chunks(self, text: str) -> list:
        """The chunks of a text; an int stands for a special token."""
        out: list = []
        for part in self.model.cut.split(text) if "<|" in text else [text]:
            if part in self.model.special:
                out.append(self.model.special[part])
                continue
            part = self.model.normal(part)
            out += part.split() if not SEPARATORS.search(part) else regex.split(r"[ \t\n\x0b\x0c\r\x85\p{Z}]+", part)
        return out

    def _learn(self, chunks: set) -> None:
        new = [c for c in chunks if isinstance(c, str)]
        pieces = []
        for c in new:  # letters are one piece, as is a mark after them that can't begin a contraction
            if c.isalpha():
                pieces.append((c.encode(),))
            elif c[-1:] in MARKS and c[:-1].isalpha():
                pieces.append((c[:-1].encode(), c[-1].encode()))
            else:
                pieces.append(tuple(p.encode() for p in self.model.pieces(c)))
        distinct = list({p for ps in pieces for p in ps})
        found = self.lexicon.lookup(distinct) if self.lexicon else [None] * len(distinct)
        ids = dict(zip(distinct, found))
        unseen = [p for p, f in ids.items() if f is None]
        ids.update(zip(unseen, self.model.merged(unseen)))
        for c, ps in zip(new, pieces):
            self.cache[c] = ids[ps[0]] if len(ps) == 1 else tuple(i for p in ps for i in ids[p])
        self.cache.update({c: (c,) for c in chunks if isinstance(c, int)})

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), SLICE):
            split = [self._chunks(t) for t in texts[i : i + SLICE]]
            if len(self.cache) > CACHED_CHUNKS:
                self.cache = {}
            cache = self.cache
            self._learn({c for c in set().union(*split) if c not in cache})  # a difference from the keys would walk the whole cache
            get = cache.__getitem__
            for chunks in split:
                yield list(chain.from_iterable(map(get, chunks)))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shipped) -> Encoder:
    """This worker's encoder for what was broadcast; one is kept across tasks, each of which fills a cache of its own."""
    name, source, lexicon = shipped.value
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(Model(source), Lexicon(lexicon) if lexicon else None)
    return _ENCODERS[name]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _letter_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of letter runs that occur twice or more in a chunk of the partition with `COUNTED_WORDS` words."""
    words: dict[int, bytes] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def flushed() -> pa.RecordBatch:
        h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
        out = pa.RecordBatch.from_arrays([pa.array([words[k] for k in h[n > 1].tolist()], pa.binary()), pa.array(n[n > 1], pa.int64())], ["word", "n"])
        words.clear()
        parts.clear()
        return out

    for batch in slices(batches):
        for texts in parted([t.encode() for t in batch.column(0).to_pylist() if t]):  # hashes take some 40 bytes a byte
            b = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
            inside = np.r_[False, _LETTER[b], False]
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            start, end = edge[::2], edge[1::2]
            h, first, n = np.unique(span_hash(prefix_hash(b), start, end), return_index=True, return_counts=True)
            parts.append((h, n))
            raw = b.tobytes()
            for k, s, e in zip(h.tolist(), start[first].tolist(), end[first].tolist()):
                if k not in words:
                    words[k] = raw[s:e]
            if len(words) > COUNTED_WORDS:
                yield flushed()
    if parts:
        yield flushed()


def frequent_words(df: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """At most `most` words, the most frequent ones first; bounded, so the driver can hold them."""
    counts = df.select(F.col(text_col).cast("string")).mapInArrow(_letter_runs, "word binary, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return top.select("word").toArrow().column(0).to_pylist()


def _shipped(df: DataFrame, model_path: str, text_col: str | None, most: int = LEXICON_WORDS):
    """Broadcasts the tokenizer file and, if a text column is given, the lexicon compiled for it."""
    with open(model_path, "rb") as f:
        source = f.read()
    lexicon = b""
    if text_col:
        model = Model(source)
        words = " ".join(w.decode("utf-8", "ignore") for w in frequent_words(df, text_col, most))
        pieces = list({p.encode(): None for p in model.pieces(model.normal(words))})
        lexicon = Lexicon.compiled(dict(zip(pieces, model.merged(pieces))))
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, source, lexicon))


def encoded(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    files = _shipped(df, model_path, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(files)
        for batch in slices(batches):
            ids = list(encoder.encode([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])
        encoder.cache = {}

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>")


def decoded(df: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids decoded with special tokens shown; a null list gives the empty text."""
    files = _shipped(df, model_path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(files).model
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, text string")


def round_trip_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every whole text in one pass."""
    files = _shipped(df, model_path, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(files)
        decimal, decode = encoder.model.decimal.__getitem__, encoder.model.decode
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches):
            n, a, b = [], [], []
            for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(hexed(" ".join(map(decimal, ids))))
                b.append(hexed(decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.cache = {}

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
