"""Posting tables: which cloud has how many points in which cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell
from ..params import GridParams


def cloud_sizes(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    return points.groupBy(key).agg(F.count("*").alias("cloud_size"))


def bag_postings(points: DataFrame, grid: GridParams, key: str = "cloud_id") -> DataFrame:
    """(cell, key, cnt): a row for all points of a cloud in a cell. Sums are made before the shuffle, so a full cell isn't hot."""
    return points.groupBy(cell(grid).alias("cell"), key).agg(F.count("*").alias("cnt"))


def set_postings(points: DataFrame, grid: GridParams, key: str = "cloud_id") -> DataFrame:
    """Distinct (cell, key)."""
    return points.select(cell(grid).alias("cell"), key).distinct()


def merged(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Postings of both: clouds can be added, also to cells that have them already."""
    return postings.unionByName(more).groupBy("cell", "cloud_id").agg(F.sum("cnt").alias("cnt"))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(cell, ids): each cloud as often as it has points there, ascending."""
    ids = F.flatten(F.array_sort(F.collect_list(F.array_repeat("cloud_id", F.col("cnt").cast("int")))))
    return postings.groupBy("cell").agg(ids.alias("ids"))


def ones_per_cell(postings: DataFrame) -> DataFrame:
    """How many clouds each cell has."""
    return postings.select("cell", "cloud_id").distinct().groupBy("cell").agg(F.count("*").alias("ones"))


def bitmaps(postings: DataFrame) -> DataFrame:
    """Clouds of each cell as bitmaps of 32768 ids: (cell, bucket, bits)."""
    return postings.groupBy("cell", F.expr("bitmap_bucket_number(cloud_id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cloud_id))").alias("bits"))


def bitmap_ones(maps: DataFrame) -> DataFrame:
    return maps.groupBy("cell").agg(F.sum(F.expr("bitmap_count(bits)")).alias("ones"))
