"""Best-fit packing: tokens by the library, slots without gaps, and as few sequences as a best fit of single pieces."""

import random
import zlib

import numpy as np
import pytest

from palletry.llm import length_packing as L
from palletry.llm.bpe_lexicon import Encoder, Model
from tests.llm.data import awkward, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_a_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 100])
    lengths = [min(capacity, max(1, int(rng.expovariate(rng.choice([0.02, 0.1, 0.5]))))) for _ in range(rng.choice([0, 1, 20, 400]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    ranks = {}
    for length, rank, count, each, first, offset in L.planned(histogram, capacity).tolist():
        ranks.setdefault(length, []).append((rank, rank + count))
        for i in range(count):
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
    for length, parts in ranks.items():
        ends = [0]
        for lo, hi in sorted(parts):
            assert lo == ends[-1]
            ends.append(hi)
        assert ends[-1] == histogram[length]
    assert set(ranks) == set(histogram) and len(used) == best_fit(lengths, capacity)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.fixture(scope="module")
def packed(spark):
    rows = awkward()
    return rows, L.packed(frame(spark, rows).repartition(7, "text"), PATH, capacity=100, keep_ids=True).cache()


def test_pieces_are_the_library_s_tokens(packed):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows, df = packed
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 100):
            own = ids[at : at + 100]
            want.append((str(doc_id), at // 100, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()) == sorted(want)


def test_slots_leave_no_gap_and_few_sequences(packed):
    rows = packed[1].collect()
    assert {r.sequence_id for r in rows} == set(range(best_fit([r.length for r in rows], 100)))
    whole = {r.sequence_id: r.ids for r in L.sequences(packed[1]).collect()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset and whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 100 and {k: len(v) for k, v in whole.items()} == ends


def test_one_length_may_hold_most_rows(spark):
    df = spark.createDataFrame([(i, "same text" if i % 4 else None) for i in range(300)], "doc_id long, text string").repartition(5)
    rows = L.packed(df, PATH, capacity=7).collect()
    assert {r.length for r in rows} == {3, 1} and len({(r.sequence_id, r.offset) for r in rows}) == 300
    assert len({r.sequence_id for r in rows}) == best_fit([r.length for r in rows], 7)


def test_nothing_to_pack(spark):
    out = L.packed(spark.createDataFrame([], "doc_id int, text string"), PATH)
    assert out.collect() == [] and out.columns == ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_a_small_cache_changes_nothing(monkeypatch):
    model = L.Model(open(PATH, "rb").read())
    texts = [f"word{i} other {i % 7}, it's <|endoftext|> {'long' * (i % 5)}" for i in range(900)]
    want = list(L.ByteEncoder(model, None).encode(texts))
    monkeypatch.setattr(L, "CACHED", 10)
    assert list(L.ByteEncoder(model, None).encode(texts)) == want


def test_a_mark_after_a_known_word_costs_no_merge(monkeypatch):
    """Most chunks are new words, with or without a mark; what is known of them is taken from the cache."""
    with open(PATH, "rb") as f:
        model = Model(f.read())
    texts = ["Wandering wandering", "wandering, wandering. it's (wandering) 12,5 ſtraße, é! <|endoftext|>, ,", "unseenword, unseenword" + "x" * 80 + ","]
    want = [np.array(x, "<u4").tobytes() for x in Encoder(model, None).encode(texts)]
    merged, merge = [], model.merged_bytes
    monkeypatch.setattr(model, "merged_bytes", lambda words: merged.extend(words) or merge(words))
    encoder = L.ByteEncoder(model, None)
    assert [next(encoder.encode([t])) for t in texts] == want
    assert merged.count(b"wandering") == 2 and b"unseenword" in merged  # bare, and as a piece between brackets
