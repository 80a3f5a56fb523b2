"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, source mix, sampled pieces.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; run() writes each stage's result to the shared folder and reads it back as the next
one's docs. All but the last stage return the columns of `documents`.

A stage's rows go to its Python workers BATCH at a time. A batch of Spark's usual 10,000 whole texts
is held several times over, in the executor and in the worker, and executors keep what they once took.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from barframe.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from barframe.session import written

NEAR_SIZE, NEAR_PERCENT = 5, 80  # words of a shingle, similarity of near-duplicates
BATCH = 512  # rows that a Python worker gets at once
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(stage: Callable) -> Callable:
    """`stage` with batches of at most BATCH rows. Its result is computed later, so the session keeps
    the setting; run() puts it back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH:  # 0 or less: no limit
            spark.conf.set(BATCH_KEY, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, learned from the labelled ones, predicts toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


@in_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the smallest id."""
    return ngram_join.keep_single(docs, NEAR_SIZE, NEAR_PERCENT)


@in_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply_mix(docs)


@in_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless: a sampled segmentation of every document."""
    import public_tokenizers

    return pieces.sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("sampled_pieces", encode_pieces),
]

# The scores of a learned lexicon and the sampled pieces cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_KEY)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH_KEY, before)
    return docs
