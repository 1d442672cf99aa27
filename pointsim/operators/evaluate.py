"""Recall of ranked answers whose truth is the query's own id, and statistics of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(ranked: DataFrame, queries: DataFrame, at: list[int], k: int | None = None, denominator: str = "all") -> DataFrame:
    """(k, recall) for each k of ``at``: the share of queries whose own id is among the first k.

    denominator: ``all`` queries, or those ``answered`` at all. ``k``, how many answers were asked for, must reach the largest of ``at``.
    """
    if k is not None and k < max(at):
        raise ValueError("recall beyond the number of answers would repeat the last one")
    if denominator not in ("all", "answered"):
        raise ValueError("denominator must be all or answered")
    asked = (queries if denominator == "all" else ranked).select("query_id").distinct()
    hits = ranked.where("cloud_id = query_id").groupBy("query_id").agg(F.min("rank").alias("rank"))
    both = asked.join(hits, "query_id", "left")
    found = [F.coalesce(F.avg(F.coalesce((F.col("rank") <= a).cast("double"), F.lit(0.0))), F.lit(0.0)) for a in at]
    pairs = F.array(*(F.struct(F.lit(a).cast("bigint").alias("k"), f.alias("recall")) for a, f in zip(at, found, strict=True)))
    return both.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.k", "p.recall")


def time_stats(times: DataFrame, column: str) -> DataFrame:
    """average, sample standard deviation (0 for one row), minimum and maximum."""
    c = F.col(column).cast("double")
    return times.agg(F.avg(c).alias("average"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"))
