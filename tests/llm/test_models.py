"""Kernels of the operators: gradients, held-out accuracy, graphs, tries, suffix order, automata."""

import random
import zlib

import numpy as np
import pytest

from palletry.llm import bpe_lexicon, common, hnsw, queries, suffix_dedup, token_counts, toxicity, trie_join

tokenizers = pytest.importorskip("public_tokenizers")


def test_gradients_match_differences():
    net = toxicity.Network({"a": 0, "b": 1})
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words, index, live = ["a", "b", "zzz"], np.array([[0, 1], [2, 0], [1, 1]]), np.array([[1, 1], [1, 1], [1, 0]], bool)
    y, keep = np.array([1.0, 0.0]), np.ones((3, toxicity.WORD_SIZE + toxicity.CHAR_SIZE))
    keep[0, : toxicity.WORD_SIZE] = keep[2, toxicity.WORD_SIZE :] = 0

    def loss():
        g = net.projected(net.inputs(words)[0] * keep)[index]
        k = 3 * toxicity.HIDDEN
        states = np.concatenate([net._direction("f", g[:, :, :k], live, None), net._direction("b", g[:, :, k:], live, None)], 2)
        logit = net._pooled(states, live)[3]
        return float((np.log1p(np.exp(logit)) - y * logit).mean())

    grad = net.gradients(words, index, live, y, np.ones(2), keep)
    for k, v in net.p.items():
        flat, g = v.reshape(-1), grad[k].reshape(-1)
        for i in np.argsort(-abs(g))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 1e-4 + 1e-2 * abs(g[i])


def test_both_layouts_of_the_network_agree():
    net = toxicity.Network({"a": 0})
    rng = np.random.default_rng(0)
    table = net.projected(net.inputs(["a", "b", "cc", "d"])[0])
    index, live = rng.integers(0, 4, (9, 5)), np.arange(9)[:, None] < np.array([9, 9, 3, 1, 0])
    g, k = table[index], 3 * toxicity.HIDDEN
    states = np.concatenate([net._direction("f", g[:, :, :k], live, None), net._direction("b", g[:, :, k:], live, None)], 2)
    assert np.allclose(net._pooled(states, live)[3], net.logits(net.halved(table), index, live), atol=1e-5)


def test_toxicity_query_scores_each_text_by_its_worst_window(spark, tmp_path):
    """The registered query against a loop over each text's windows, one at a time, in the layout of training."""
    rng = random.Random(5)
    common, bad = [f"w{i}" for i in range(60)], ["vile", "odious"]
    texts = [" ".join(rng.choice(common) for _ in range(rng.choice([1, 20, 64, 65, 400]))) for _ in range(120)]
    texts = [t + " " + rng.choice(bad) if i % 3 == 0 else t for i, t in enumerate(texts)] + ["", None, " \n ", "Vile! " * 3000]
    texts[1] = texts[2] = ""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.score for r in queries.queries()["op4_toxicity"](spark, str(tmp_path)).collect()}

    learned = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    net = toxicity.trained([texts[i] for i in learned], np.array([int(i % 3 == 0) for i in learned]))
    k = 3 * toxicity.HIDDEN

    def logit(words):
        live = np.ones((max(1, len(words)), 1), bool) if words else np.zeros((1, 1), bool)
        g = net.projected(net.inputs([toxicity.canonical(w) for w in words] or [""])[0])[:, None]
        states = np.concatenate([net._direction("f", g[:, :, :k], live, None), net._direction("b", g[:, :, k:], live, None)], 2)
        return float(net._pooled(states, live)[3][0])

    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        worst = max(logit(words[s : s + 64]) if len(words) - s >= 64 or s == 0 else logit(words[-64:]) for s in starts)
        assert abs(got[i] - 1 / (1 + np.exp(net.shift - worst))) < 1e-4, i


def test_toxicity_trains_on_empty_texts():
    for texts in (["", "", "vile", "w1 w2"], ["", "", " ", ""]):
        net = toxicity.trained(texts, np.array([0, 1, 1, 0]))
        assert all(np.isfinite(v).all() for v in net.p.values()) and np.isfinite(net.shift)
        assert np.isfinite(list(toxicity.Scorer(net).scores(["", "vile", "w1"]))).all()


def test_toxicity_cut_is_the_best_over_whole_texts():
    """Texts of some 190 windows with one toxic passage, some wrongly labelled: no cut may make fewer errors than 0.5."""
    rng = np.random.default_rng(8)
    common, bad = [f"w{i}" for i in range(400)], [f"vile{i}" for i in range(12)]
    texts, y = [], []
    for i in range(80):
        words = rng.choice(common, 9000 if i % 2 else 120).tolist()
        toxic = i % 4 < 2
        if toxic:
            at = int(rng.integers(len(words)))
            words[at:at] = rng.choice(bad, 3).tolist()
        texts.append(" ".join(words))
        y.append(int(toxic) if rng.random() > 0.15 else int(not toxic))
    y = np.array(y)
    net = toxicity.trained(texts, y)
    score = np.array(list(toxicity.Scorer(net).scores(texts)))
    errors = [int(((score >= cut) != y).sum()) for cut in [*np.unique(score), 2.0]]
    assert int(((score >= 0.5) != y).sum()) == min(errors)
    long = np.arange(80) % 2 == 1
    clean = long & (np.arange(80) % 4 >= 2)
    assert (score[long & ~clean & (y == 1)] >= 0.5).mean() > 0.9 and (score[clean & (y == 0)] < 0.5).mean() > 0.9


def test_toxicity_held_out():
    rng = random.Random(1)
    bad = ["grumble", "snark", "vexing", "odious"]

    def text(toxic):
        w = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    y = np.array([i % 4 == 0 for i in range(900)], int)
    texts = [text(t) for t in y]
    net = toxicity.trained(texts[:600], y[:600])
    score = np.array(list(toxicity.Scorer(net).scores(texts[600:])))
    assert ((score >= 0.5) == y[600:]).mean() > 0.95


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        w = toxicity.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(a[1] > b[0] for a, b in zip(w, w[1:]))


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 32)) * rng.uniform(0.5, 2, (1500, 1))
    q = rng.standard_normal((60, 32))
    found = hnsw.Graph(x).search(q, 20)
    true = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), true.tolist())]) > 0.95


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).round(2)
    x[50:150] = x[50]  # one very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 7 + [None]), (None, [1.0] * 8), (7, [float(v) for v in x[7]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnsRenamed({}).selectExpr("*", "1 as key", "2 as v")
    got = {}
    for r in hnsw.nearest(df, 5, shard_points=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(s - x[i] @ x[j]) < 1e-9 for _, j, s in found)
        s = x @ x[i]
        want = sorted((j for j in range(400) if j != i), key=lambda j: (-round(s[j], 9), j))[:5]
        hits += len({j for _, j, _ in found} & set(want))
    assert hits >= 95
    assert hnsw.nearest(df.where("false")).count() == 0


def test_trie_links():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = int(rng.integers(2, 25))
        base = [rng.integers(0, 300, int(rng.integers(5, 150))) for _ in range(3)]
        sets = []
        for _ in range(m):
            b = base[rng.integers(0, 3)]
            b = np.r_[b[rng.random(len(b)) > rng.choice([0, 0.05, 0.1, 0.2])], rng.integers(0, 900, int(rng.integers(0, 10))), 1]
            sets.append(np.unique(b).astype(np.uint64))
        trie = trie_join.Trie(sets[1:])
        for probe in sets:
            both = [len(set(probe.tolist()) & set(s.tolist())) for s in sets[1:]]
            want = [i for i, (b, s) in enumerate(zip(both, sets[1:])) if 100 * b >= 80 * (len(s) + len(probe) - b)]
            assert sorted(trie.linked(probe, 80)) == want


def test_shingle_sets_agree():
    texts = [b"", b" ", b"a", b"a b c d e f", b"A B c d e", "é 中 x y z w".encode(), b"one\ttwo\nthree four five six seven"] * 3
    assert all(np.array_equal(a, common.shingle_set(t, 5)) for a, t in zip(common.shingle_sets(texts, 5, 40), texts))


def test_suffix_order():
    rng = np.random.default_rng(0)
    for nth in range(80):
        m, w = int(rng.integers(1, 50 if nth else 3000)), 40
        pool = rng.integers(0, 2, (5, w)).astype(np.uint8)
        rows = pool[rng.integers(0, 5, m)].copy()
        for r in rows:
            if rng.random() < 0.7:
                r[rng.integers(0, w)] = rng.integers(0, 256 if nth % 2 else 3)
        g = rng.integers(0, 3, m)
        order, common_ = suffix_dedup.suffix_order(g, rows)
        keys = [(g[i], rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, m):
            if g[order[k]] == g[order[k - 1]]:
                d = rows[order[k]] != rows[order[k - 1]]
                assert common_[k] == (d.argmax() if d.any() else w)


def test_lexicon_and_long_pieces():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        model = bpe_lexicon.Model(f.read())
    library = Tokenizer.from_file(path)
    rng = random.Random(0)
    pool = "abzZ ÉéΣσİıñ中文①½٣'’\t\n\x0b\x1c\x85\xa0 <|endoftext|>.!?_-😀"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a" * 400, "hello" * 50, "中文" * 60, "It's WE'RE o'clock", "<|startoftext|>x<|endoftext|>"]
    words = [w.encode() for w in ("hello", "clock", "a", "ab", "abz")]
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.Lexicon.compiled(dict(zip(words, model.merged(words)))))
    assert lexicon.lookup([b"clock", b"cloc", b"hellos", b"ab"]) == [model.merged([b"clock"])[0], None, None, model.merged([b"ab"])[0]]
    for used in (lexicon, None):
        got = list(bpe_lexicon.Encoder(model, used).encode(texts))
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [model.decode(i) for i in got] == [library.decode(i, skip_special_tokens=False) for i in got]


def test_token_allocation():
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoding, sizes = token_counts._encoder(f.read(), tokenizers.PATTERN)
    rng = random.Random(4)
    for text in ["", "a\n\n\nb", "é\n日本\n\n", "words and more words\nover two lines\n", "x" * 300]:
        ids = encoding.encode_ordinary(text)
        bounds = np.r_[0, np.cumsum(sizes[np.array(ids, int)])].astype(int)
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        for s, e in (token_counts.line_spans(text), (np.array(cuts[:-1], int), np.array(cuts[1:], int))):
            b = [len(text[:i].encode()) for i in s], [len(text[:i].encode()) for i in e]
            for rule in token_counts.RULES:
                want = np.zeros(len(s))
                for x, y in zip(bounds[:-1], bounds[1:]):
                    over = [max(0, min(y, q) - max(x, p)) for p, q in zip(*b)]
                    for k, (p, q) in enumerate(zip(*b)):
                        want[k] += {"first": p <= x < q, "last": p < y <= q, "split": over[k] / (y - x), "largest": bool(over) and over[k] > 0 and k == over.index(max(over))}[rule]
                got = token_counts.allocated(bounds, token_counts.byte_offsets(text, text.encode(), s), token_counts.byte_offsets(text, text.encode(), e), rule)
                assert np.allclose(got, want)
