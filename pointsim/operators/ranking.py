"""Top k in a total order, so that ties fall the same way each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import check_k


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1. Spark limits groups before and after the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= check_k(k)).withColumn("rank", F.col("rank").cast("bigint"))


def top_votes(votes: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, cloud_id, votes): most votes first, then the smaller cloud_id."""
    return top(votes, ["query_id"], [F.desc("votes"), F.asc("cloud_id")], k).select("query_id", "rank", "cloud_id", "votes")


def top_distances(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, cloud_id, distance): nearest first, then the smaller cloud_id."""
    return top(pairs, ["query_id"], [F.asc("distance"), F.asc("cloud_id")], k).select("query_id", "rank", "cloud_id", "distance")
