"""Whole indexes: build once, add clouds, answer batches of queries, report."""

from .index import KINDS, CloudIndex, PerformanceReport

__all__ = ["KINDS", "CloudIndex", "PerformanceReport"]
