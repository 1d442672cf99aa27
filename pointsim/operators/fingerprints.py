"""Constellation fingerprints: an anchor and a point in its target zone, as (y of both, distance in x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lattice
from ..params import FingerprintParams
from .ranking import top
from .voting import shared_votes


def on_lattice(points: DataFrame, params: FingerprintParams, key: str = "cloud_id") -> DataFrame:
    """(key, x, y, cnt) in whole lattice steps; points that meet are one row with a count."""
    return points.groupBy(key, lattice(F.col("x"), params.delta).alias("x"), lattice(F.col("y"), params.delta).alias("y")).agg(F.count("*").alias("cnt"))


def zone_pairs(points: DataFrame, params: FingerprintParams, zone: str, key: str = "cloud_id") -> DataFrame:
    """(key, ax, ay, acnt, px, py, pcnt): anchors with the points of their zone, which is ``open`` or ``closed``.

    A range self-join within a cloud as an equi-join: points lie in columns as wide as a zone, an anchor is dealt to
    the two columns that its zone may touch.
    """
    if zone not in ("open", "closed"):
        raise ValueError("zone must be open or closed")
    own = on_lattice(points, params, key)
    width, half = params.delta_x, params.delta_y // 2
    lo = F.col("ax") + params.delay_x
    anchors = own.select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cnt").alias("acnt"))
    if not params.clip_bottom:
        anchors = anchors.where(F.col("ay") >= half)
    column = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    anchors = anchors.withColumn("__column", F.explode(F.sequence(column(lo), column(lo + width))))
    targets = own.select(key, F.col("x").alias("px"), F.col("y").alias("py"), F.col("cnt").alias("pcnt"), column(F.col("x")).alias("__column"))
    dy = F.abs(F.col("py") - F.col("ay"))
    if zone == "open":
        inside = (F.col("px") > lo) & (F.col("px") < lo + width) & (dy < half)
    else:
        inside = (F.col("px") >= lo) & (F.col("px") <= lo + width) & (dy <= half)
    return anchors.join(targets, [key, "__column"]).where(inside).drop("__column")


def fingerprints(points: DataFrame, params: FingerprintParams, zone: str, key: str = "cloud_id") -> DataFrame:
    """(key, y1, y2, dx, cnt): prints of each anchor with the first ``limit`` points of its zone by (x, y).

    Points that meet on the lattice are interchangeable, so they are ranked together: each row takes as many of its
    points as the rows before leave of the limit.
    """
    pairs = zone_pairs(points, params, zone, key)
    ranked = top(pairs, [key, "ax", "ay"], [F.asc("px"), F.asc("py")], params.limit)
    before = F.sum("pcnt").over(W.partitionBy(key, "ax", "ay").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) - F.col("pcnt")
    taken = F.least(F.col("pcnt"), F.lit(params.limit) - before)
    kept = ranked.withColumn("taken", taken).where("taken > 0")
    return kept.groupBy(key, F.col("ay").alias("y1"), F.col("py").alias("y2"), (F.col("px") - F.col("ax")).alias("dx")).agg(F.sum(F.col("taken") * F.col("acnt")).alias("cnt"))


def fingerprint_votes(index: DataFrame, qpoints: DataFrame, params: FingerprintParams, zone: str = "open") -> DataFrame:
    """index: prints of the clouds. A vote for each pair of equal prints."""
    return shared_votes(fingerprints(qpoints, params, zone, "query_id"), index, ["y1", "y2", "dx"])
