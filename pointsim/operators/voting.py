"""Votes of query points for the clouds that share their cells or prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell
from ..params import GridParams, check_k
from .pairs import Classes
from .postings import bag_postings
from .ranking import top
from .tallies import countable, most_votes, tallied


def shared_votes(query: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """query (on, query_id, cnt), index (on, cloud_id, cnt): sum of products. Both sides are counted before the join, so it
    meets a row for each cloud and key, not for each point."""
    votes = F.sum(F.col("cnt") * F.col("__n"))
    return query.join(index.withColumnRenamed("cnt", "__n"), on).groupBy("query_id", "cloud_id").agg(votes.alias("votes"))


def _dealt(index: DataFrame, qpoints: DataFrame, grid: GridParams, packed: bool = False) -> tuple[Classes, DataFrame]:
    """Classes of clouds, and the queries' counts; index: (cell, cloud_id, cnt)."""
    classes = Classes(index.withColumnRenamed("cnt", "__w"), ["cell", "__w"], packed=packed)
    return classes, classes.dealt(qpoints.select(cell(grid).alias("cell"), "query_id")).groupBy("cell", "query_id").agg(F.count("*").alias("cnt"))


def _met(index: DataFrame, qpoints: DataFrame, grid: GridParams, each=None) -> tuple[Classes, list[DataFrame]]:
    """Votes of classes, block by block."""
    classes, query = _dealt(index, qpoints, grid)
    return classes, classes.met(query, ["cell"], F.sum(F.col("cnt") * F.col("__w")).alias("votes"), each=each)


def grid_votes(postings: DataFrame, qpoints: DataFrame, grid: GridParams) -> DataFrame:
    """A vote for each pair of a query point and an indexed point in one cell."""
    classes, votes = _met(postings, qpoints, grid)
    return classes.members(votes)


def top_voted(postings: DataFrame, qpoints: DataFrame, grid: GridParams, k: int) -> DataFrame:
    """(query_id, rank, cloud_id, votes): the first k by votes, then the smaller cloud_id; no pair leaves the task that counts it.

    Where ids are whole numbers, votes are counted in arrays (``tallies``), otherwise pairs are rows of a join.
    """
    check_k(k)
    if countable((postings, "cloud_id"), (qpoints, "query_id")):
        classes, query = _dealt(postings, qpoints, grid, packed=True)
        votes = tallied(classes, query, most_votes(k), ["votes"], "__w")
        return classes.nearest(votes, "votes", k, descending=True).select("query_id", "rank", "cloud_id", "votes")
    best = lambda votes: top(votes, ["query_id"], [F.desc("votes"), F.asc("cloud_id")], k).drop("rank")
    classes, votes = _met(postings, qpoints, grid, best)
    return classes.nearest(votes, "votes", k, descending=True).select("query_id", "rank", "cloud_id", "votes")


def without_last(postings: DataFrame) -> DataFrame:
    """Set postings without the largest cloud_id of each cell."""
    last = postings.groupBy("cell").agg(F.max("cloud_id").alias("__last"))
    return postings.join(last, "cell").where("cloud_id < __last").drop("__last")


def ones(postings: DataFrame, literal_last_skip: bool = False) -> DataFrame:
    """(cell, cloud_id, 1), however many points a cloud has there.

    literal_last_skip leaves the largest cloud_id of each cell out, as a known slip in the published method does.
    """
    own = without_last(postings) if literal_last_skip else postings
    return own.select("cell", "cloud_id", F.lit(1).cast("bigint").alias("cnt"))


def succinct_votes(postings: DataFrame, qpoints: DataFrame, grid: GridParams, literal_last_skip: bool = False) -> DataFrame:
    """A vote of each query point for every cloud of its cell; ``literal_last_skip`` as in ``ones``."""
    return grid_votes(ones(postings, literal_last_skip), qpoints, grid)


def most_voted(votes: DataFrame) -> DataFrame:
    """The mode of each query's votes: one cloud a query, in one aggregation without a sort."""
    best = F.max(F.struct("votes", (-F.col("cloud_id")).alias("id")))
    return votes.groupBy("query_id").agg(best.alias("best")).select("query_id", (-F.col("best.id")).alias("cloud_id"), F.col("best.votes").alias("votes"))
