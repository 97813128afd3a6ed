"""Chat formatting, token counts over tables, components and the pipeline."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.data import WORD, awkward, frame, linked, sha, shingles

from palletry.llm import chat_format, components, mixing, token_counts, toxicity

tokenizers = pytest.importorskip("public_tokenizers")


def test_events_fold(spark):
    log = [
        (1, 0, "start", 0, "user", None), (1, 1, "delta", 0, None, "hel"), (1, 2, "delta", 0, None, "lo"), (1, 3, "start", 1, "assistant", None), (1, 4, "delta", 1, None, "first"),
        (1, 5, "start", 2, "user", None), (1, 6, "delta", 2, None, "dropped by regeneration"), (1, 7, "regenerate", 1, None, None), (1, 8, "delta", 1, None, "second"), (1, 9, "edit", 0, None, "hi"),
        (1, 10, "delta", 0, None, "!"), (None, 1, "start", 0, "tool]", None), (None, 2, "delta", 0, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, op string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.folded(df).collect()}
    assert got == {(1, 0): ("user", "hi!"), (1, 1): ("assistant", "second"), (None, 0): ("tool]", "")}
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_back(chat_format.rendered(chat_format.folded(df))).collect()}
    assert back == {1: [("user", "hi!"), ("assistant", "second")], None: [("tool]", "")]}
    assert chat_format.folded(df.where("false")).count() == 0


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l\\e[[<<SYS>>]]", "", None, "\\", "<s>", "[ROLE x]", "é😀 <", "\\\\b"]
    rows = [(c, i, ["system", "user", "assistant", None, "r[\\]"][(i + c) % 5], t) for c in range(3) for i, t in enumerate(texts)] + [(5, 1, "user", "same"), (5, 1, "user", "same"), (5, None, "assistant", "null turn first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "op": F.lit("x"), "piece": F.lit("y")})
    out = {r.conv_id: r for r in chat_format.chat_digests(df.unionByName(chat_format.probe(spark), allowMissingColumns=True)).collect()}
    assert set(out) == {-1, 0, 1, 2, 5}
    for c, r in out.items():
        own = sorted(((t if t is not None else -9, role or "", x or "") for k, t, role, x in rows if k == c)) if c >= 0 else [(0, "user", texts[0]), (1, "assistant", texts[0])]
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_log_of_turns_holds_drafts_edits_and_regenerations(spark):
    long = "é[</s>" * 60_000
    rows = [(1, 0, "user", "hello world"), (1, 1, "assistant", "one two three"), (1, 2, "user", ""), (1, 3, "assistant", "é"), (2, 0, "user", long), (2, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat_format.log_of_turns(df)
    assert {r.op: r.n for r in log.groupBy("op").agg(F.count("*").alias("n")).collect()} == {"start": 6, "delta": 24, "edit": 3, "regenerate": 3}
    assert sorted((r.conv_id, r.turn - 1, r.role, r.text) for r in chat_format.folded(log).collect()) == rows
    out = {r.conv_id: r for r in chat_format.chat_digests(df).collect()}
    assert out[2].loss_chars == len(long) and out[2].loss_sha256 == sha(long)
    assert chat_format.chat_digests(df.where("false")).count() == 0


def test_section_tokens(spark):
    df = frame(spark, awkward()).withColumn("sections", F.expr("array(named_struct('name', 'head', 'start', 0, 'end', 7), named_struct('name', 'rest', 'start', 7, 'end', cast(null as int)))"))
    args = (tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    lines = token_counts.section_tokens(df, *args)
    assert lines.groupBy("id").agg((F.sum("n_tokens") - F.sum(F.when(F.col("section") == 0, F.col("doc_tokens")))).alias("d")).where("d <> 0").count() == 0
    for rule in token_counts.RULES:
        two = token_counts.section_tokens(df, *args, sections_col="sections", rule=rule)
        assert two.count() == 2 * df.count()
        assert two.groupBy("id").agg(F.abs(F.sum("n_tokens") - F.sum("doc_tokens") / 2).alias("d")).where("d > 1e-6").count() == 0
    assert token_counts.section_tokens(df.where("false"), *args).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(df, *args, rule="other")


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 300), (7, 7), (900, 901)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[300] == 300 and got[901] == 900
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def _pipeline_folder(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stages(spark, tmp_path):
    """Null and repeated ids, empty and long texts and clashing names through all stages, each against brute force."""
    import corpus_pipeline

    rows = awkward(3)
    docs = frame(spark, rows)
    _pipeline_folder(spark, str(tmp_path), docs, [(i, int(i % 5 == 0)) for i in range(40)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, [(r.doc_id, r.text, r.source) for r in before.collect()]))
        if name != "BPE encoding":
            assert docs.columns == before.columns and docs.where("score <> 0.5 or key <> 'k'").count() == 0
    assert [n for n, _ in seen] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "BPE encoding"]
    at = dict(seen)
    scores = toxicity.scored(spark.read.parquet(f"{tmp_path}/documents.parquet").drop("score"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert Counter(at["exact dedup"]) == Counter((r.doc_id, r.text, r.source) for r in scores.where("score < 0.5").collect())

    least = lambda d: (d is None, d or 0)
    kept = {}
    for d, t, s in at["exact dedup"]:
        if (t or "") not in kept or (d is not None and (kept[t or ""][0] is None or d > kept[t or ""][0])):
            kept[t or ""] = (d, t or "")
    assert Counter((d, t or "") for d, t, _ in at["n-gram Jaccard join"]) == Counter(kept.values())

    sets = [shingles(t) for _, t, _ in at["n-gram Jaccard join"]]
    best = {}
    for (d, t, _), root, s in zip(at["n-gram Jaccard join"], linked(sets), sets):
        key = root if s else ("alone", d, t)
        best[key] = min(best.get(key, (d, t)), (d, t), key=lambda x: least(x[0]))
    assert Counter((d, t) for d, t, _ in at["mixing"]) == Counter(best.values())

    plan = mixing.mix_plan(spark.createDataFrame(at["mixing"], "doc_id long, text string, source string")).collect()
    uses = Counter()
    for r in plan:
        uses[r.id, r.size] += sum(r.before + e * r.source_size + r.size / 2 <= r.target for e in (0, 1)) if r["size"] else 1
    assert Counter((d, len(WORD.findall(t or ""))) for d, t, _ in at["BPE encoding"]) == +uses
    assert Counter(r.doc_id for r in docs.collect()) == Counter(d for d, _, _ in at["BPE encoding"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    _pipeline_folder(spark, str(tmp_path), frame(spark, awkward()[:1]).where("false"), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
