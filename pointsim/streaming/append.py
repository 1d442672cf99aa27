"""Append a stream's points to a posting table, a folder for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.postings import bag_postings
from ..params import GridParams


def append_postings(points: DataFrame, path: str, checkpoint: str, grid: GridParams, available_now: bool = True) -> StreamingQuery:
    """Start a query that adds the points of each micro-batch to the table at ``path``.

    A batch that is run again after a failure overwrites its own folder, so its points count once.
    """

    def put(batch: DataFrame, number: int) -> None:
        bag_postings(batch, grid).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(cell, cloud_id, cnt) over all batches."""
    return spark.read.parquet(path).groupBy("cell", "cloud_id").agg(F.sum("cnt").alias("cnt"))
