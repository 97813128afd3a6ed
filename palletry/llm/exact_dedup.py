"""Exact duplicate removal with a heavy-hitter split (DataFrame operations only).

1. Every text becomes a SHA-256 digest; a narrow table (id, row number, digest) is written once.
2. A Misra-Gries family sketch (`approx_top_k_*`, merged in two levels) names at most `TOP_K` frequent
   digests. The exact count and the surviving row of these are found by a map-side combined aggregation.
3. The verified winners, at most `TOP_K` rows, are broadcast; their copies are settled without a shuffle.
4. All other digests go through one ordinary shuffle; none of them can hold a large share of the rows.

Defined results: null text equals the empty text; ties of the largest id (repeated rows) leave one row;
a null id loses against any other, and a group of null ids keeps one row with `keep_id` null; an empty table
gives an empty result; further columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palletry.llm.common import row_key, written

TOP_K, TRACKED, LANES = 1024, 4096, 32


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """(id, row, digest) and, if wanted, the row's key: `row` tells apart rows that agree in everything."""
    return written(
        df.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
            *([row_key(F.col(id_col), F.col(text_col)).alias("key")] if key else []),
        ),
        "digests",
    )


def frequent(d: DataFrame, top_k: int = TOP_K, tracked: int = TRACKED) -> DataFrame:
    """At most `top_k` digests that may be frequent: sketches by lane, then one merge of `LANES` sketches."""
    lanes = d.groupBy((F.spark_partition_id() % LANES).alias("lane")).agg(F.expr(f"approx_top_k_accumulate(hex(digest), {tracked}) AS sketch"))
    one = F.floor(F.col("lane") / LANES)  # a group key, as a partition without rows would have no sketch to combine
    merged = lanes.groupBy(one.alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked}) AS sketch"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {top_k})")).alias("t")).select(F.unhex("t.item").alias("digest"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """(id, row, digest, keep_id, group_size, kept) and, if wanted, the key: one row for each input row."""
    d = digests(df, id_col, text_col, key)
    if d.isEmpty():
        heavy = d.select("digest")
    else:
        heavy = written(frequent(d), "frequent")
    winners = (
        d.join(F.broadcast(heavy), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    winners = F.broadcast(written(winners, "winners"))
    group = Window.partitionBy("digest")
    rest = d.join(winners, "digest", "left_anti").withColumns(
        {"keep": F.max(F.struct("id", "row")).over(group), "group_size": F.count("*").over(group)}
    )
    both = d.join(winners, "digest").unionByName(rest)
    return both.select("id", "row", "digest", *(["key"] if key else []), F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that an equal text with a larger id (or, at the same id, one equal row) replaces."""
    groups = exact_groups(docs, id_col, text_col, key=True).where("kept").select("key")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))  # so no column can clash
    rows = rows.withColumn("key", row_key(F.col("doc")[id_col], F.col("doc")[text_col]))
    first = Window.partitionBy("key").orderBy(F.lit(0))
    return rows.join(groups, "key", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc.*")
