"""Registered queries of the training-data operators (production parameters, whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import (embedding_dedup, kneser_ney, language_id, lexical_search, mixing, periodic_runs, pieces, pii,
                            quality_rules, secrets, sharding, simhash, suffix_dedup)
from cohortlens.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=(3, 2), cap=2)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                               quantile=0.995)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"), min_probability=0.9, train_rows=50_000)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_texts(read_table(spark, sf_dir, "documents"), length=100)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), seed=0, dropout=0.1)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"), k=50)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.plant_runs(read_table(spark, sf_dir, "documents"))
    found = periodic_runs.collapse_runs(docs, min_length=24, min_repeats=3)
    best = periodic_runs.most_repeated(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_embedding_dedup, op3_secret_scan, op4_source_mixing, op5_virtual_slots, op6_kneser_ney, op7_pii, op8_simhash_dedup, op9_suffix_dedup,
                                op10_sentencepiece, op11_lexical_search, op12_language_id, op13_periodic_runs)}
