"""The corpus pipeline: stages over documents, each written as Parquet and reread for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import byte_bpe, dart_minhash, quality_rules, string_tiling, suffix_trees
from rollcall.llm.shared import materialised, prepared, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepared(spark)
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepared(spark)
    return dart_minhash.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that came earlier go; so do documents of which nothing is left.

    A changed text is its kept words with one space between them, and n_chars follows; a text
    without repeats stays as it was.
    """
    prepared(spark)
    rest = suffix_trees.removed(docs).where((F.col("_n_removed") == 0) | (F.col("_n_removed") < F.col("_n_words")))
    changed = F.col("_n_removed") > 0
    values = {"text": F.when(changed, F.col("_kept")).otherwise(F.col("text")),
              "n_chars": F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))}
    return rest.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    prepared(spark)
    return string_tiling.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit integers), decoded again as a proof."""
    prepared(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encoded_and_decoded(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

# Outlier estimates, signatures and tokens can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: doc_id, n_tokens, ids and two digests of those that stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
