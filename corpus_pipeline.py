"""Corpus pipeline: documents through the training-data operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import mixing, pieces, quality_rules, secrets, simhash
from cohortlens.llm.common import read_table, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the repetition rules."""
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits)."""
    return simhash.keep_one_per_group(docs, shingle=3, max_distance=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts; every row stays."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0, 1 or 2 times)."""
    return mixing.apply_mix(docs, weights=(3, 1, 2), share=(3, 2), cap=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix: (doc_id, ids, n_tokens, n_bytes, lossless); each copy skips merges of its own."""
    return pieces.encode_documents(docs, seed=0, dropout=0.1, copies=True)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scan),
          ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

# Fingerprints, lexing, keyed rounding and sub-word merges are not SQL; tests/llm
# holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
