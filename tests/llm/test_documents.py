"""The operators over documents against brute force, with nulls, empties, ties, repeats, long texts and clashing names."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.data import WORD, awkward, frame, linked, sha, shingles, without_repeats

from palletry.llm import bpe_lexicon, exact_dedup, mixing, sharding, suffix_dedup, toxicity, trie_join

ROWS = awkward()
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ROWS[:1]).where("doc_id < 0")


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    members = defaultdict(list)
    for d, t, _ in ROWS:
        members[t or ""].append(d)
    assert len(got) == len(ROWS) and Counter(r.id for r in got) == Counter(d for d, _, _ in ROWS)
    by_digest = {sha(t): ds for t, ds in members.items()}
    for r in got:
        own = by_digest[bytes(r.digest).hex()]
        assert r.group_size == len(own)
        assert r.keep_id == max((d for d in own if d is not None), default=None)
    assert sum(r.kept for r in got) == len(members)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_with_heavy_hitter(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id div 2) end as text")
    got = exact_dedup.exact_groups(df)
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000
    assert got.where("kept").count() == df.select("text").distinct().count()


def test_drop_copies_keeps_columns_and_one_row_a_text(docs, empty):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns and got.count() == len({t or "" for _, t, _ in ROWS})
    assert exact_dedup.drop_copies(empty).count() == 0


def test_trie_join_groups(docs, empty):
    sets = [shingles(t) for _, t, _ in ROWS]
    roots = linked(sets)
    least = {}
    for (d, _, _), r in zip(ROWS, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, len(s), least.get(r) if s else d) for (d, _, _), s, r in zip(ROWS, sets, roots))
    for options in ({}, {"lanes": 1, "chunk": 300, "part": 200}):
        got = Counter((r.id, r.n_shingles, r.component_id) for r in trie_join.grouped(docs, **options).collect())
        assert got == want
    assert trie_join.grouped(empty).count() == 0
    kept = trie_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)


def test_suffix_dedup(docs, empty):
    short = docs.where("length(text) < 5000 or text is null")
    rows = [r for r in ROWS if len(r[1] or "") < 5000]
    for options in ({}, {"hot": 3}, {"hot": 3, "map_bits": 8}):
        got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(short, length=50, gram=16, **options).collect())
        kept = without_repeats([t for _, t, _ in rows], 50)
        assert got == Counter((d, len((t or "").encode()), len((t or "").encode()) - len(k), n, sha(k)) for (d, t, _), (k, n) in zip(rows, kept))
    assert suffix_dedup.removed(docs).count() == len(ROWS)
    assert suffix_dedup.removed(empty).count() == 0


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = Counter(tuple(r) for r in bpe_lexicon.round_trip_digests(docs, path).collect())
    want = Counter()
    for d, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe_lexicon.round_trip_digests(empty, path).count() == 0
    ids = bpe_lexicon.encoded(docs, path)
    texts = {r.id: r.text for r in bpe_lexicon.decoded(ids, path).collect()}
    assert texts[103] == library.decode(library.encode("one two", add_special_tokens=False).ids, skip_special_tokens=False)


def test_mix_targets_and_rows(docs, empty):
    size = {k: 0 for _, _, k in ROWS}
    for _, t, s in ROWS:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        for s in over or list(open_):
            target[s] = 2 * size[s] if over else left * weight[s] / total
            open_.discard(s)
        left -= sum(target[s] for s in over)
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert len(rows) == len(ROWS)
    taken = Counter()
    for r in rows:
        s = names[r.nth]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, plan.select("id", "taken", "position").fillna(-1).collect())) == sorted(map(tuple, mixing.mix_plan(docs).select("id", "taken", "position").fillna(-1).collect()))
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    uses = Counter()
    for r in rows:
        n = [e for e in (0, 1) if r.before + e * r.source_size + r.size / 2 <= r.target] if r["size"] else [0]
        uses[r.id, names[r.nth], r["size"]] += len(n)
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mix.select("doc_id", "source", "text").collect())
    assert got == +uses
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_curriculum_moves_sources_over_time(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'a b c d' as text", "concat('s', id % 3) as source")
    p = mixing.mix_plan(df)
    early = {r.nth: r.early for r in p.where("position is not null").groupBy("nth").agg({"position": "avg"}).withColumnRenamed("avg(position)", "early").collect()}
    assert early[0] < early[1] < early[2]


def test_mix_of_repeated_and_null_ids(spark):
    """Ids that sources share, with other texts, don't swap places, and each source's words come near its target."""
    rows = [(i % 7 if i % 3 else None, " ".join(["w"] * (i % 11)), f"s{i % 4}") for i in range(400)]
    df = frame(spark, rows).repartition(7)
    target = {names: t for names, t in mixing.mix_plan(df).select(F.concat(F.lit("s"), "nth"), "target").distinct().collect()}
    words = Counter()
    for r in mixing.mixed_documents(df, slots=9).select("source", "text").collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - t) <= 11 for s, t in target.items())


def test_mix_is_one_shuffle_of_texts_in_order_of_time(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'a b c d' as text", "concat('s', id % 3) as source")
    mix = mixing.mixed_documents(df, slots=600)
    seen = [r.source for r in mix.select("source").collect()]
    early, late = Counter(seen[: len(seen) // 4]), Counter(seen[-len(seen) // 4 :])
    assert early["s0"] > late["s0"] and early["s2"] < late["s2"]
    assert len(re.findall(r"Exchange (hash|range)partitioning", mix._jdf.queryExecution().executedPlan().toString())) == 1


@pytest.mark.parametrize("slots", [3, 40, None])
def test_mix_stands_in_the_exact_order_of_positions(spark, slots):
    """Fewer slots than documents or more: every use comes at the time its source has demanded the words before it."""
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 5 % 3}") for i in range(300)] + [(1000 + i, "", "t") for i in range(20)]
    df = frame(spark, rows).repartition(6)
    plan = mixing.mix_plan(df).collect()
    want = []
    for r in plan:
        for use in (0, 1):
            before = r.before + use * r.source_size
            if (use == 0 if r["size"] == 0 else before + r["size"] / 2 <= r.target):
                part = min(before / r.target, 1.0) if r.target else None
                want.append((part, r.nth, r.key, r.id))
    times = spark.createDataFrame([(i, p, n) for i, (p, n, _, _) in enumerate(want)], "i long, p double, n int")
    at = {r.i: r.t for r in times.select("i", mixing.time_of(F.col("p"), F.col("n")).alias("t")).collect()}
    at = {i: int(want[i][2][:8], 16) / 2**32 if t is None or want[i][0] is None else t for i, t in at.items()}
    order = [want[i][3] for i in sorted(at, key=lambda i: (at[i], want[i][1], want[i][2]))]
    got = [r.doc_id for r in mixing.mixed_documents(df, slots=slots).select("doc_id").collect()]
    assert got == order and len(got) > 300


def test_sharding(docs, empty):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.filled_table(shards, 251)
    share = Counter(table)
    assert set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.filled_table(shards[:-1], 251)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 251 * 0.3
    got = sharding.place(docs, "doc_id", shards, 251)
    assert got.columns == [*docs.columns, "slot", "shard"] and got.count() == len(ROWS)
    import hashlib

    for r in got.select("doc_id", "slot", "shard").collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.place(empty, "doc_id", shards, 251).count() == 0
    with pytest.raises(ValueError):
        sharding.filled_table(shards, 250)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 30)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels)
    assert sorted(got.columns) == sorted(docs.columns)  # a column named score is replaced
    rows = got.select("doc_id", "text", "score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.scored(docs, labels.where("false")).where("score <> 0").count() == 0
    assert toxicity.scored(empty, labels).count() == 0


def test_texts_go_to_the_scoring_tasks_once(spark, docs, monkeypatch):
    """Memory of tasks and workers goes by the width of the rows sent; copies of the text made an executor of the pipeline too large."""
    import corpus_pipeline

    sent, send = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: (sent.append(self.schema.simpleString()), send(self, *a, **k))[1])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    monkeypatch.setattr(corpus_pipeline.toxicity, "fitted", lambda *_: toxicity.Network({"a": 0}))
    monkeypatch.setattr(type(spark.read), "parquet", lambda *_: labels)
    out = corpus_pipeline.clean(spark, docs, "")
    assert len(sent) == 1 and sent[0].count("text:string") == 1
    scores = toxicity.scored(docs.drop("score"), labels).where("score < 0.5").drop("score")
    assert out.columns == docs.columns and sorted(map(str, out.select(*scores.columns).collect())) == sorted(map(str, scores.collect()))
    binary = toxicity.scored(docs.select("doc_id", F.col("text").cast("binary").alias("text")), labels).select("score").collect()
    assert sorted(r.score for r in binary) == sorted(r.score for r in toxicity.scored(docs, labels).collect())


def test_word_counts_take_little_memory():
    """Texts are hashed a few at a time, however many a batch has."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{chr(97 + (i * j) % 26)}ord{chr(97 + j % 26)}" for j in range(600)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    found = Counter()
    for b in bpe_lexicon._letter_runs(iter([batch])):
        found.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == Counter(w.encode() for t in texts for w in t.split())
    assert peak < 15 * sum(map(len, texts))  # 5.5 times now, 37 before


def test_held_out_labels_cannot_reach_training(spark):
    rng = np.random.default_rng(3)
    text = lambda bad: " ".join([*rng.choice([f"w{i}" for i in range(60)], 12), *(["vile"] if bad else [])])
    rows = [(i, text(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert 0 < len(held) < 60
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, int((i % 3 == 0) != (flip and i in held))) for i in range(120)], "doc_id long, toxic int")
        got = toxicity.scored(docs, labels).select("doc_id", "score").collect()
        scores.append({r.doc_id: r.score for r in got})
    assert scores[0] == scores[1] and len(scores[0]) == 120
    assert np.mean([(scores[0][i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.9
    assert len({s for i, s in scores[0].items()}) > 1
