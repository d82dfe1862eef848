"""The dealt operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridledger.llm import (
    dart_minhash, decontaminate, filter_audit, license_scan, line_dedup, merkle, mixing, oracles, shards, suffix_dedup,
    token_counts, toxicity, vector_dedup, window_dedup,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_digest(table(spark, sf_dir, "documents"))


def op5_earlier_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_earlier_digest(table(spark, sf_dir, "documents"), from_files=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts_digest(table(spark, sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_links(table(spark, sf_dir, "embeddings"))


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats_digest(table(spark, sf_dir, "documents"), from_files=True)


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_copies_digest(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


def op12_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines_digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_shards": op4_shards,
    "op5_earlier_strings": op5_earlier_strings,
    "op6_token_counts": op6_token_counts,
    "op7_near_vectors": op7_near_vectors,
    "op8_repeated_windows": op8_repeated_windows,
    "op9_near_copies": op9_near_copies,
    "op10_mix": op10_mix,
    "op11_manifest": op11_manifest,
    "op12_repeated_lines": op12_repeated_lines,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op4_shards": oracles.SHARDS,
    "op5_earlier_strings": oracles.EARLIER_STRINGS,
    "op7_near_vectors": oracles.NEAR_VECTORS,
    "op8_repeated_windows": oracles.REPEATED_WINDOWS,
    "op9_near_copies": oracles.NEAR_COPIES,
    "op10_mix": oracles.MIX,
    "op11_manifest": oracles.MANIFEST,
    "op12_repeated_lines": oracles.REPEATED_LINES,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
