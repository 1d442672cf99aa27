"""Box intersection: which share of a cloud lies in boxes around a query's points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import Classes


def counted(points: DataFrame, key: str) -> DataFrame:
    """Equal points of a cloud as one row with a count, so that repeated points aren't joined one by one."""
    return points.groupBy(key, "x", "y").agg(F.count("*").alias("cnt"))


def _met(points: DataFrame, qpoints: DataFrame, delta: float, sized: bool) -> tuple[Classes, list[DataFrame]]:
    """Hits of classes of equal clouds, block by block; sized: and their cloud_size."""
    if delta <= 0:
        raise ValueError("delta must be positive")
    side, half = F.lit(float(delta)), F.lit(delta / 2.0)
    tile = lambda c: F.floor(c / side).cast("bigint")
    dealt = lambda rows: counted(rows, "cloud_id").withColumn("tx", tile(F.col("x"))).withColumn("ty", tile(F.col("y")))
    classes = Classes(points, ["x", "y"], dealt)
    boxes = counted(classes.dealt(qpoints.select("query_id", "x", "y")), "query_id")
    boxes = boxes.select("query_id", *((F.col(c) + s * half).alias(n) for c, s, n in (("x", -1, "x0"), ("x", 1, "x1"), ("y", -1, "y0"), ("y", 1, "y1"))), F.col("cnt").alias("__n"))
    boxes = boxes.withColumn("tx", F.explode(F.sequence(tile(F.col("x0")), tile(F.col("x1"))))).withColumn("ty", F.explode(F.sequence(tile(F.col("y0")), tile(F.col("y1")))))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    sizes = classes.rows.groupBy("cloud_id").agg(F.sum("cnt").alias("cloud_size")) if sized else None
    return classes, classes.met(boxes, ["tx", "ty"], F.sum(F.col("cnt") * F.col("__n")).alias("hits"), where=inside, more=sizes)


def box_hits(points: DataFrame, qpoints: DataFrame, delta: float) -> DataFrame:
    """(query_id, cloud_id, hits): pairs of an indexed point and a box of side ``delta``, border included, that holds it.

    A range join as an equi-join: points lie in tiles of side delta, and each box is dealt to the tiles that it
    touches, four at most.
    """
    classes, hits = _met(points, qpoints, delta, sized=False)
    return classes.members(hits)


def box_support(points: DataFrame, qpoints: DataFrame, delta: float, epsilon: float = 0.0) -> DataFrame:
    """(query_id, cloud_id, hits, cloud_size, support) with support = hits / cloud_size above epsilon. A point in several boxes counts for each."""
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    classes, hits = _met(points, qpoints, delta, sized=True)
    found = [rows.withColumn("support", F.col("hits") / F.col("cloud_size")).where(F.col("support") > F.lit(float(epsilon))) for rows in hits]
    return classes.members([rows.select("query_id", "cloud_id", "hits", "cloud_size", "support") for rows in found])
