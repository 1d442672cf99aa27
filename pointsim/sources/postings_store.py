"""Posting tables on disk, as Parquet or ORC, sorted by cell within files so that cell filters skip row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc")


def save_postings(postings: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    postings.sortWithinPartitions("cell").write.format(kind).mode(mode).save(path)


def load_postings(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    return spark.read.format(kind).load(path)
