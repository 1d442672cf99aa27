"""Pairs of queries and clouds, summed up where they arise: no shuffle holds a row for each pair.

Clouds with equal rows have equal pairs, so only the one with the smallest id is joined (a class). Queries are dealt by their id, once; the
classes' rows come to every task in blocks of bounded size. A pair's rows then meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize, materialize_tidily
from .ranking import top

#: Rows of the index that a task is sent at once, and pairs that it is to sum up.
BLOCK_ROWS, BLOCK_PAIRS = 400_000, 2_000_000
#: How many times as many rows a packed block has, and query points that a task then takes.
PACKED, TASK_POINTS = 20, 500_000
CLASS = ["__n", "__name", "__other", "__null"]


class Classes:
    """An index (cloud_id, *what), a row for each value of ``what`` that a cloud has, by clouds that differ.

    A cloud is named by its number of rows and 128 bits of them. made: what becomes of the rows of classes' first clouds; values may then repeat,
    and the index is read twice instead of being written whole. packed: the rows are for ``tallies``, which counts pairs in arrays.
    """

    def __init__(self, index: DataFrame, what: list[str], made: Callable[[DataFrame], DataFrame] | None = None, packed: bool = False):
        self.spark, self.packed = index.sparkSession, packed
        low = lambda h: F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))  # noqa: E731  sums, as equal rows would cancel out
        hashed = lambda seed: (lambda h: F.xxhash64(low(h), low(F.shiftrightunsigned(h, 32))))(F.xxhash64(F.lit(seed), *what))
        index = index.select("cloud_id", *what)
        index = index if made else materialize_tidily(index, "pair-index")
        names = index.groupBy("cloud_id").agg(F.count("*").alias("__n"), hashed(1).alias("__name"), hashed(2).alias("__other"))
        self.names = materialize_tidily(names.withColumn("__null", F.col("cloud_id").isNull()), "pair-names")
        firsts = self.names.groupBy(CLASS).agg(F.min("cloud_id").alias("first"), F.count("*").alias("copies"))
        self.firsts = materialize_tidily(firsts, "pair-classes")
        self.classes = self.firsts.count()
        own = index.join(self.firsts.select("first"), F.col("cloud_id").eqNullSafe(F.col("first")), "left_semi")
        self.rows = materialize_tidily(made(own) if made else own, "pair-rows")
        self.blocks = max(1, math.ceil(self.rows.count() / (BLOCK_ROWS * (PACKED if packed else 1))))
        #: a block with a cloud far larger than it should be isn't sent to every task
        self.sent = packed or self.blocks == 1 or max(r["count"] for r in self.rows.groupBy(self._number()).count().collect()) <= 4 * BLOCK_ROWS

    def _number(self) -> Column:
        return F.pmod(F.xxhash64("cloud_id"), F.lit(self.blocks))

    def block(self, rows: DataFrame, j: int) -> DataFrame:
        """What a table (cloud_id, ..) of first clouds has of block j."""
        return rows if self.blocks == 1 else rows.where(self._number() == j)

    def _of(self, rows: DataFrame, j: int) -> DataFrame:
        own = self.block(rows, j)
        return F.broadcast(own) if self.sent else own

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Queries' rows, all of a query in one partition, such that a block's pairs fit a task."""
        if self.packed:
            parts = math.ceil(rows.count() / TASK_POINTS)
        else:
            queries = rows.select("query_id").distinct().count()
            parts = math.ceil(queries * self.classes / self.blocks / BLOCK_PAIRS)
        return rows.repartition(max(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "query_id")

    def meeting(self, j: int, query: DataFrame, on: list[str], value: Column, keys: tuple[str, ...] = ("query_id",), where: Column | None = None, more: DataFrame | None = None) -> DataFrame:
        """(*keys, cloud_id, value) of block j, of classes' first clouds; query: as ``dealt`` has left it. more: (cloud_id, ..) of all first clouds, added to their pairs."""
        pairs = query.join(self._of(self.rows, j), on)
        pairs = (pairs if where is None else pairs.where(where)).groupBy(*keys, "cloud_id").agg(value)
        return pairs if more is None else pairs.join(self._of(more, j), "cloud_id")

    def met(self, *what, each: Callable[[DataFrame], DataFrame] | None = None, **how) -> list[DataFrame]:
        """``meeting`` for every block. each: what is made of a block's pairs, written before the next block begins."""
        blocks = (self.meeting(j, *what, **how) for j in range(self.blocks))
        if each is None:
            return list(blocks)
        return [each(pairs) if self.blocks == 1 else materialize(each(pairs), "pair-block") for pairs in blocks]

    def members(self, pairs: list[DataFrame]) -> DataFrame:
        """Blocks' pairs for every cloud, not classes' first ones only.

        A class's clouds are one array, so that a pair meets one row and is spread out from that. Pairs of a class are written together: the same
        array again and again takes little room in a file.
        """
        if self.classes == self.names.count():
            return union(pairs)
        own = materialize_tidily(self.names.join(self.firsts.drop("copies"), CLASS).select("first", "cloud_id"), "pair-members")
        parts = max(1, math.ceil(own.count() / self.blocks / (4 * BLOCK_ROWS)))
        # a cloud without id is a class of its own; where there is none, numbers are joined, which is faster
        same = (lambda a, b: a == b) if own.where("first is null").isEmpty() else Column.eqNullSafe
        out, columns = [], pairs[0].columns
        for j, rows in enumerate(pairs):
            rows = rows.withColumnRenamed("cloud_id", "first")
            rows = rows.sortWithinPartitions("first", "query_id").where(F.spark_partition_id() >= 0)  # which keeps Spark from dropping the order before a join
            block = own if self.blocks == 1 else own.where(F.pmod(F.xxhash64("first"), F.lit(self.blocks)) == j)
            for p in range(parts):
                part = block if parts == 1 else block.where(F.pmod(F.xxhash64(F.lit(7), "cloud_id"), F.lit(parts)) == p)
                clouds = F.when(F.col("first").isNull(), F.array(F.col("first"))).otherwise(F.collect_list("cloud_id"))  # a list leaves nulls out
                part = part.groupBy("first").agg(clouds.alias("__clouds"))
                met = rows.join(F.broadcast(part), same(rows["first"], part["first"]))
                out.append(met.select(*(c for c in columns if c != "cloud_id"), F.explode("__clouds").alias("cloud_id")).select(columns))
        return union(out)

    def nearest(self, pairs: list[DataFrame], by: str, k: int, descending: bool = False) -> DataFrame:
        """(query_id, rank, cloud_id, by): the first k clouds of each query by ``by``, then cloud_id; pairs: of first clouds, with their first k at least.

        A class whose first cloud isn't among the first k has none there: those first clouds come before all of its own.
        """
        order = [F.desc(by) if descending else F.asc(by), F.asc("cloud_id")]
        best = top(union(pairs), ["query_id"], order, k)
        if self.classes == self.names.count():
            return best
        firsts = self.firsts.where("copies > 1").select("first", "copies")
        # clouds that are surely nearer, from classes that are: of the others no more are needed than k leaves
        best = best.join(firsts, F.col("cloud_id").eqNullSafe(F.col("first")), "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))
        near, tied = W.partitionBy("query_id").orderBy(order[0]).rangeBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("query_id", by)
        most = F.least("copies", F.lit(k))
        best = best.withColumn("__need", F.lit(k) - F.sum(most).over(near) + F.sum(most).over(tied)).where("__need > 0").drop("rank", "first", "copies")
        members = top(self.names, CLASS, [F.asc("cloud_id")], k).join(self.firsts.where("copies > 1"), CLASS).select("first", F.col("cloud_id").alias("__cloud"), F.col("rank").alias("__place"))
        every = best.join(members, F.col("cloud_id").eqNullSafe(F.col("first")) & (F.col("__place") <= F.col("__need")), "left")
        every = every.withColumn("cloud_id", F.when(F.col("first").isNull() & F.col("__place").isNull(), F.col("cloud_id")).otherwise(F.col("__cloud"))).drop("first", "__cloud", "__place", "__need")
        return top(every, ["query_id"], order, k)


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
