"""A corpus pipeline: toxic documents go, copies go, one of each group of near copies stays, sources are mixed to
their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet into the shared folder
and reads again for the next one. All but the last return the columns of `documents`, whatever these are called.

Defined results: a null or empty text counts as an empty text, which is scored like any other, is one group of copies, has
no near copies, and is used once by the mix, at the time its place comes; its encoding has no tokens. Null ids stay apart
from each other unless their texts agree; in a group, a row with an id stays before one without. Rows that agree in id and
text are copies. Texts of any length are processed whole. Ties of scores decide nothing (only the bound does), ties of ids
leave one row. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palletry.llm import bpe_lexicon, exact_dedup, mixing, toxicity, trie_join
from palletry.llm.common import written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5; the network learns from the labelled ones among `docs`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.below(docs, labels, 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 on five-word shingles the one with the least doc_id."""
    return trie_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the order of the curriculum, up to twice or not at all as their source's target has it."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix."""
    return bpe_lexicon.round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("n-gram Jaccard join", unlike), ("mixing", mixed), ("BPE encoding", encoded)]

#: A recurrent network's decisions have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
