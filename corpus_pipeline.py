"""From raw documents to token ids: quality, exact and near duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
:func:`run` writes to the shared folder and reads again as the next one's documents. All but the last return the
columns of documents. What Python sees of them comes in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowplace.llm import exact_refine, piece_trie, quality_pu, simhash_pivots, winnow
from flowplace.llm.queries import table, vocabulary
from flowplace.session import materialise, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels that may be learnt from."""
    return quality_pu.keep_good(small_batches(docs), table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts, the one with the largest id."""
    return exact_refine.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: shingles of five words, similarity of 0.8 or more."""
    return simhash_pivots.drop_similar(small_batches(docs), words=5, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of ten words with a benchmark item."""
    return winnow.drop_contaminated(small_batches(docs), table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text that they give back, as digests."""
    return piece_trie.round_trip(small_batches(docs), vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("pieces", pieces),
]

# Fits, fingerprints and piece tables have no counterpart in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
