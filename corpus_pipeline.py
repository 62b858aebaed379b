"""Corpus pipeline: language ID, exact dedup, near-dedup, source mixing, SentencePiece encoding.

Each stage gets what its predecessor kept, written as Parquet and reread.
The stages hand texts to Python in batches bounded by bytes: a batch of 10,000
texts, Spark's default, is held by the executor and by its worker, both ways.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnwise.llm import exact_dedup, langid, mixing, near_dedup, sentencepiece_lattice
from churnwise.llm.common import read, stage

#: Bound of an Arrow batch between an executor and its Python worker.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(apply: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``apply`` with the batches bounded; the setting stays, for a stage's rows are made after it returned."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return apply(spark, docs, sf_dir)
    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact_dedup.first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.first_of_classes(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the words that each source's target takes, a row per document and round."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and round_trip of every row of the mix."""
    return sentencepiece_lattice.encode(docs)


STAGES = [(name, bounded(apply)) for name, apply in
          (("language_id", language_id), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mix), ("sentencepiece", encode))]

#: The stages are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded mix of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
