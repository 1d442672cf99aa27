"""Running sums in a total order, without all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize


def summed_before(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str, put: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """df with the sum of each column of ``sums`` over the rows before, in a total order. A written table; put: what writes tables.

    Rows are dealt by ranges and summed up within them; only one row of each range is ordered in a single task.
    """
    own = df.select("*", *(c.alias(f"__own_{k}") for k, c in sums.items()))
    dealt = put(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), name)
    ranges = dealt.groupBy("__range").agg(*(F.sum(f"__own_{k}").alias(f"__all_{k}") for k in sums))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(F.col("__range").alias("__of"), *(F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__until_{k}") for k in sums))
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.select("*", *(F.coalesce(F.sum(f"__own_{k}").over(inside), F.lit(0)).alias(f"__in_{k}") for k in sums))
    rows = rows.join(ranges, F.col("__range") == F.col("__of"))
    return put(rows.select(*df.columns, *((F.col(f"__until_{k}") + F.col(f"__in_{k}")).alias(k) for k in sums)), name)
