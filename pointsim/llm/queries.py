"""Queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, mixing, near, quality, secrets, sharding, token_counts, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), token_counts.revision(), token_counts.Rules(_tokenizer()))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.report(docs, licenses.fit(docs))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def _tokenizer() -> str:
    """The vocabulary file, at the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode(_table(spark, sf_dir, "documents"), token_files.Format(_tokenizer()))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slots(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.classes(_table(spark, sf_dir, "documents"), near.Rules(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing_sources": mixing.ORACLE,
        "op5_warc": warc.ORACLE,
        "op8_benchmark_decontamination": decontaminate.ORACLE,
        "op10_minhash_near_dedup": near.ORACLE,
    }
