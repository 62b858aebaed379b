"""Queries of the training-data operators: each takes (spark, sf_dir) and returns the whole result."""

from __future__ import annotations

from churnwise.llm import embedding_dedup, exact_dedup, filter_audit, langid, mixing, near_dedup, quality, runs, sentencepiece_lattice, sharding, suffix_lm, token_counts, toxicity
from churnwise.llm.common import read


def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_lattice.encode(read(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return suffix_lm.score_texts(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return runs.run_report(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_sharding(spark, sf_dir):
    return sharding.shard_assignment(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_language_id, op3_exact_dedup, op4_quality_classifier, op5_sentencepiece,
    op6_token_counts, op7_toxicity, op8_minhash_near_dedup, op9_mixing, op10_lm_scoring, op11_periodic_runs, op12_filter_audit, op13_sharding)}
SQL = {"op1_embedding_near_dedup": embedding_dedup.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE,
       "op6_token_counts": token_counts.ORACLE, "op11_periodic_runs": runs.ORACLE, "op12_filter_audit": filter_audit.ORACLE,
       "op13_sharding": sharding.ORACLE}
