"""Point clouds as long tables: (cloud_id, point_id, x, y), a row a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cloud_id double, x double, y double"


def within(bounds: tuple[float, float]) -> Column:
    """Both coordinates within the bounds, which belong to them; NaN never is."""
    lo, hi = map(float, bounds)
    inside = lambda c: (F.col(c) >= lo) & (F.col(c) <= hi) & ~F.isnan(c)
    return inside("x") & inside("y")


def read_clouds_csv(spark: SparkSession, path: str, bounds: tuple[float, float] | None = (0, 10_000), header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Lines ``id, x, y``. Blanks around fields are dropped, blank lines skipped, ids truncated to whole numbers; lines with a
    negative id are dropped.

    mode: FAILFAST raises on a malformed line, DROPMALFORMED drops it. bounds None keeps every line. Lines have no number of
    their own; point_id is null.
    """
    rows = spark.read.schema(SCHEMA).csv(path, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nanValue="nan", mode=mode, enforceSchema=True)
    rows = rows.where(F.col("cloud_id") >= 0)
    if bounds is not None:
        rows = rows.where(within(bounds))
    return rows.select(F.col("cloud_id").cast("bigint").alias("cloud_id"), F.lit(None).cast("bigint").alias("point_id"), "x", "y")


def write_clouds_csv(points: DataFrame, path: str) -> None:
    points.select(F.col("cloud_id").alias("ID"), F.col("x").alias("X"), F.col("y").alias("Y")).write.csv(path, header=True)


def clouds_from_events(events: DataFrame) -> DataFrame:
    """A cloud a user: x is the time within 30 days, y the value, both scaled to 0..10000."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return events.select(
        F.col("user_id").cast("bigint").alias("cloud_id"),
        F.col("event_id").cast("bigint").alias("point_id"),
        (micros / F.lit(2592000000000.0) * F.lit(10000.0)).alias("x"),
        F.least(F.col("value") * F.lit(20.0), F.lit(10000.0)).alias("y"),
    )


def clouds_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A cloud a supplier: x is the price, y a scattered part and order number. point_id isn't unique."""
    scattered = (F.col("l_partkey").cast("bigint") * 7919 + F.col("l_orderkey").cast("bigint") * 104729) % 1000003
    return lineitem.select(
        F.col("l_suppkey").cast("bigint").alias("cloud_id"),
        (F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber")).alias("point_id"),
        F.least(F.col("l_extendedprice").cast("double") / F.lit(10.5), F.lit(10000.0)).alias("x"),
        (scattered * F.lit(10000.0) / F.lit(1000003.0)).alias("y"),
    )


def jittered(points: DataFrame, reach: float, cmax: float = 10_000) -> DataFrame:
    """Queries: every cloud with each of its points moved by up to ``reach`` on either axis, within [0, cmax)."""

    def moved(c: str, factor: int) -> Column:
        step = ((F.col("point_id") * factor) % 201 - 100) * F.lit(float(reach)) / F.lit(100.0)
        return F.greatest(F.lit(0.0), F.least(F.col(c) + step, F.lit(float(cmax - 1))))

    return points.select(F.col("cloud_id").alias("query_id"), "point_id", moved("x", 37).alias("x"), moved("y", 53).alias("y"))


def disturbed(points: DataFrame, percent: int = 10, cmax: float = 10_000) -> DataFrame:
    """Queries: every cloud with about ``percent`` of its points somewhere else (mirrored), the others as they are."""
    off = (F.col("point_id") * 37) % 100 < percent
    mirrored = lambda c: F.when(off, F.lit(float(cmax)) - F.col(c)).otherwise(F.col(c)).alias(c)
    return points.select(F.col("cloud_id").alias("query_id"), "point_id", mirrored("x"), mirrored("y"))
