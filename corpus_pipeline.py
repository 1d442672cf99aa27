"""From documents to token files: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage works on all that the stage before kept; its result is written as Parquet in the folder that the
cluster shares, and read again as the next one's documents. ``run`` removes these tables at the end: the result reads token files' rows.

Defined results are those of the stages: texts without words don't pass the quality rules, so that null and empty texts end there;
rows without doc_id go through by their texts, and come first in the files; of rows of one doc_id one is left after the second stage; texts
of any length pass whole; an empty table of documents gives no rows, an empty benchmark takes nothing away, and without labels the base
rules decide alone. Extra columns, whatever their names, are passed on to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pointsim.llm import decontaminate, mixing, near, quality, token_files
from pointsim.llm.common import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which learns from labelled documents."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filtered(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return near.filtered(docs, near.Rules())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages."""
    return decontaminate.filtered(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32, file, place."""
    return token_files.encode(docs, token_files.Format(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: SQL can't express the trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as held:
        for name, stage in STAGES[:-1]:
            docs = held.put(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
