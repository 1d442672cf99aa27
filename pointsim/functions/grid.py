"""Cells of a square grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GridParams


def lattice(value: Column, step: int) -> Column:
    """Number of the step that a coordinate lies in."""
    return F.floor(value / F.lit(float(step))).cast("bigint")


def cell(grid: GridParams, x: Column | None = None, y: Column | None = None) -> Column:
    """Number of the cell of (x, y), which must not be negative."""
    x = F.col("x") if x is None else x
    y = F.col("y") if y is None else y
    return lattice(x, grid.delta) + F.lit(grid.stride).cast("bigint") * lattice(y, grid.delta)
