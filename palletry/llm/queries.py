"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token belongs to the line of its first byte."""
    import public_tokenizers

    from palletry.llm import token_counts

    out = token_counts.section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "section", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import sharding

    shards = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shards)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import mixing

    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.orderBy("position", "id").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import trie_join

    return trie_join.grouped(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import exact_dedup

    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palletry.llm import bpe_lexicon

    out = bpe_lexicon.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import chat_format

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.chat_digests(turns.unionByName(chat_format.probe(spark)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import suffix_dedup

    return suffix_dedup.removed(_table(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("id", "doc_id")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import hnsw

    return hnsw.nearest(_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import whitening

    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palletry.llm import length_packing

    return length_packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op13_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palletry.llm import drake_clusters

    return drake_clusters.cluster_report(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    names = [op1_token_counts, op2_sharding, op3_mixing, op4_toxicity, op5_trie_join, op6_exact_dedup, op7_bpe_lexicon, op8_chat_format, op9_suffix_dedup, op10_hnsw,
             op11_whitening, op12_best_fit_packing, op13_drake_clusters]
    return {f.__name__: f for f in names} | {"pipeline": pipeline}


_SIZES = r"SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, MD5(COALESCE(doc_id::VARCHAR, '')) AS key FROM documents"

OP3_SQL = f"""
WITH d AS ({_SIZES}),
s AS (SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, (SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
  SUM(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
  ROW_NUMBER() OVER (ORDER BY cap / weight, nth) AS place FROM w),
t AS (SELECT *, LEAST(cap::DOUBLE, (SELECT ARG_MIN(rest / weights, place) FROM r WHERE rest / weights * weight <= cap) * weight) AS target FROM r),
p AS (SELECT d.*, t.nth, t.source_size, t.target, COALESCE(SUM(size) OVER (PARTITION BY t.nth ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (GREATEST(0, LEAST(size, ROUND(target)::BIGINT - ahead)) + GREATEST(0, LEAST(size, ROUND(target)::BIGINT - ahead - source_size)))::BIGINT AS taken, ahead::DOUBLE / target AS part FROM p)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN ROUND(CASE nth % 3
    WHEN 0 THEN CASE WHEN part <= 1 THEN 0.0::DOUBLE + (SQRT(GREATEST(2.25::DOUBLE - 2 * part, 0)) - 1.5::DOUBLE) / -1 ELSE 1 END
    WHEN 1 THEN part
    ELSE CASE WHEN part <= 0.375 THEN SQRT(0.25::DOUBLE + 2 * part) - 0.5::DOUBLE ELSE 0.5::DOUBLE + SQRT(1 + 2 * (part - 0.375::DOUBLE)) - 1 END END, 6) END AS position
FROM q
"""

OP2_SQL = """
WITH RECURSIVE s AS (SELECT i, ('0x' || SUBSTR(MD5('offset:' || name), 1, 15))::BIGINT % 8191 AS off, ('0x' || SUBSTR(MD5('skip:' || name), 1, 15))::BIGINT % 8190 + 1 AS skip
  FROM (SELECT i, 'shard-' || LPAD(i::VARCHAR, 3, '0') AS name FROM RANGE(64) r(i))),
fill AS (SELECT 0::BIGINT AS turn, (SELECT LIST(-1::SMALLINT) FROM RANGE(8191)) AS t
  UNION ALL
  SELECT turn + 1, t[:slot] || [i::SMALLINT] || t[slot + 2:] FROM (
    SELECT turn, t, i, (off + LIST_POSITION(LIST_TRANSFORM(RANGE(8191), lambda j: t[(off + j * skip) % 8191 + 1]), -1) * skip - skip) % 8191 AS slot
    FROM fill JOIN s ON s.i = turn % 64 WHERE turn < 8191)),
lookup AS (SELECT UNNEST(RANGE(8191)) AS slot, UNNEST(t) AS claim FROM fill WHERE turn = 8191),
d AS (SELECT doc_id, ('0x' || SUBSTR(MD5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 8191 AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || LPAD(claim::VARCHAR, 3, '0') AS shard FROM d JOIN lookup USING (slot)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents)
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY text) AS keep_id, COUNT(*) OVER (PARTITION BY text) AS group_size,
  doc_id = MAX(doc_id) OVER (PARTITION BY text) AS kept, SHA256(text) AS text_sha256 FROM d
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, LENGTH(text) + LENGTH(REGEXP_REPLACE(text, '[^\\<\[\]]', '', 'g'))
  + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + LENGTH(role) + LENGTH(REGEXP_REPLACE(role, '[^\\<\[\]]', '', 'g')) END AS chars FROM c)
SELECT conv_id, COUNT(*) AS n_turns, SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(SUM(LENGTH(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  SHA256(COALESCE(STRING_AGG(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds over all vectors and centroids; `AS MATERIALIZED` keeps each from being computed again."""
    far = "LIST_SUM(LIST_TRANSFORM(LIST_ZIP({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = [
        """v AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS r, vec_id, LIST_TRANSFORM(embedding, lambda c: FLOOR(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE LEN(embedding) = 64 AND LEN(LIST_FILTER(embedding, lambda c: c IS NOT NULL AND ISFINITE(c))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY SHA256('2:' || vec_id), x) - 1 AS j, x AS c FROM v QUALIFY j < {k})",
    ]
    for i in range(rounds + 1):
        d = far.format(a="v.x", b=f"c{i}.c")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, ANY_VALUE(vec_id) AS vec_id, ANY_VALUE(x) AS x, ARG_MIN(j, (d, j)) AS j, MIN(d) AS d FROM (SELECT v.*, c{i}.j, {d} AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            ctes.append(
                f"""m{i} AS (SELECT j, LIST(m ORDER BY p) AS c FROM (SELECT j, p, FLOOR_DIV(SUM(e), COUNT(*)) AS m FROM (SELECT j, UNNEST(x) AS e, UNNEST(RANGE(64)) AS p FROM a{i}) GROUP BY j, p) GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT j, COALESCE(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))"""
            )
    ctes = [c.replace("FLOOR_DIV(SUM(e), COUNT(*))", "((SUM(e) - ((SUM(e) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*))::BIGINT") for c in ctes]
    n = rounds
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, j::INT AS cluster, d AS distance, SUM(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, SUM(d) OVER ()::BIGINT AS inertia,
  SHA256(ARRAY_TO_STRING(c{n}.c, ',')) AS centroid_sha256 FROM a{n} JOIN c{n} USING (j)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op3_mixing": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op8_chat_format": OP8_SQL, "op13_drake_clusters": _op13_sql()}
