"""Distances as columns. Point metrics take (qx, qy, x, y); set distances (shared, size a, size b)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PointMetric = Callable[[Column, Column, Column, Column], Column]
SetMetric = Callable[[Column, Column, Column], Column]


def l2_squared(qx: Column, qy: Column, x: Column, y: Column) -> Column:
    return (qx - x) * (qx - x) + (qy - y) * (qy - y)


def l2(qx: Column, qy: Column, x: Column, y: Column) -> Column:
    return F.sqrt(l2_squared(qx, qy, x, y))


def floor_l2(qx: Column, qy: Column, x: Column, y: Column) -> Column:
    """Whole-number distance."""
    return F.floor(l2(qx, qy, x, y)).cast("bigint")


def angular(shared: Column, a: Column, b: Column) -> Column:
    """Angle between two sets as 0/1 vectors; rounding may take the cosine past 1, which is an angle of 0."""
    cosine = shared / (F.sqrt(a) * F.sqrt(b))
    return F.when(cosine >= 1.0, F.lit(0.0)).otherwise(F.acos(cosine))


def hamming(shared: Column, a: Column, b: Column) -> Column:
    """Cells in one set only."""
    return (a + b - 2 * shared).cast("double")


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """1 - shared / union."""
    return F.lit(1.0) - shared / (a + b - shared)


def closeness(shared: Column, a: Column, b: Column) -> Column:
    """Falls as the angle grows. Equal fractions are equal numbers, unlike their angles: ranks go by it."""
    return shared.cast("double") * shared / (a * b)
