"""Clouds as sets of occupied cells, and their nearest sets by angular, Hamming or Jaccard distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angular, cell, hamming, jaccard
from ..functions.distance import SetMetric, closeness
from ..params import GridParams, check_k
from ..storage import materialize
from .ordered import summed_before
from .pairs import Classes, union
from .postings import set_postings
from .ranking import top
from .tallies import Table, countable, near_sets, nearest_sets, tallied

#: Sizes of a query, shared cells and sizes of a cloud for which a metric is worked out beforehand.
MOST_CASES = 2_000_000
METRICS: dict[str, SetMetric] = {"angular": angular, "hamming": hamming, "jaccard": jaccard}


def cell_sets(points: DataFrame, grid: GridParams, key: str = "cloud_id") -> DataFrame:
    """(key, cells, n): the distinct cells of each cloud, ascending."""
    return set_postings(points, grid, key).groupBy(key).agg(F.array_sort(F.collect_set("cell")).alias("cells")).withColumn("n", F.size("cells").cast("bigint"))


_SHARED = lambda: F.count("*").alias("shared")


def inner_products(index: DataFrame, query: DataFrame) -> DataFrame:
    """index: set postings; query: (cell, query_id), repeated or not. (query_id, cloud_id, shared) of pairs that share a cell."""
    classes = Classes(index, ["cell"])
    return classes.members(classes.met(classes.dealt(query.select("cell", "query_id")).distinct(), ["cell"], _SHARED()))


class _Sets:
    """Classes of clouds with equal sets, and the queries' sets as they are dealt to tasks."""

    def __init__(self, points: DataFrame, qpoints: DataFrame, grid: GridParams, packed: bool = False):
        self.classes = Classes(set_postings(points, grid), ["cell"], packed=packed)
        self.sizes = self.classes.firsts.select(F.col("first").alias("cloud_id"), F.col("__n").alias("n"), "copies")
        self.cells = self.classes.dealt(qpoints.select(cell(grid).alias("cell"), "query_id")).distinct()
        self.query = self.cells.withColumn("qn", F.count("*").over(W.partitionBy("query_id")))
        self.queries = self.query.select("query_id", "qn").distinct()

    def table(self, value: Column) -> Table | None:
        """value of (shared, qn, n) for all that can be, ranked in Spark's order, nulls first; none where that is too much, or without clouds."""
        distinct = lambda df, c: [r[0] for r in df.select(c).distinct().limit(MOST_CASES + 1).collect()]
        sizes, others = distinct(self.cells.groupBy("query_id").agg(F.count("*").alias("qn")), "qn"), distinct(self.sizes, "n")
        if not sizes or not others or len(sizes) * len(others) * (most := min(max(sizes), max(others)) + 1) > MOST_CASES:
            return None
        spark = self.classes.spark
        cases = spark.createDataFrame([(q,) for q in sizes], "qn long").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in others], "n long")))
        cases = cases.withColumn("shared", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("qn", "n"))))
        found = cases.select("qn", "shared", "n", value.alias("value")).toArrow()
        sizes, others, empty = np.sort(sizes), np.sort(others), found["value"].is_null().to_numpy()
        _, ranks = np.unique(found["value"].fill_null(0).to_numpy(), return_inverse=True)
        values = np.zeros((len(sizes), most, len(others)), np.int32)
        values[np.searchsorted(sizes, found["qn"].to_numpy()), found["shared"].to_numpy(), np.searchsorted(others, found["n"].to_numpy())] = np.where(empty, 0, ranks + 1)
        return Table(sizes, others, values)

    def pairs(self, each: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
        """(query_id, qn, cloud_id, shared, n, copies) of classes that share a cell with the query."""
        return self.classes.met(self.query, ["cell"], _SHARED(), ("query_id", "qn"), more=self.sizes, each=each)

    def first_disjoint(self, queries: DataFrame, k: int, order: list) -> list[DataFrame]:
        """(query_id, cloud_id, n) for each block: the first k classes in ``order`` that share no cell with the query.

        Every class has its place in the order. The i-th class that a query does share cells with, at place r, has r - i disjoint
        ones before it; so the j-th disjoint one has place j plus the number of shared ones with r - i < j. Each query makes k rows.
        """
        few = self.query.join(queries.select("query_id"), "query_id", "left_semi")
        blocks = []
        for b in range(self.classes.blocks):
            own = self.classes.block(self.sizes.select("cloud_id", "n"), b)
            placed = summed_before(own, order, {"rank": F.lit(1)}, "set-places").withColumn("rank", F.col("rank") + 1)
            hits = self.classes.meeting(b, few, ["cell"], _SHARED(), more=placed.select("cloud_id", "rank"))
            hits = hits.withColumn("before", F.col("rank") - F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
            steps = hits.where(F.col("before") < k).groupBy("query_id", "before").agg(F.count("*").alias("cnt"))
            steps = steps.groupBy("query_id").agg(F.collect_list(F.struct("before", "cnt")).alias("steps"))
            shift = lambda j: F.aggregate(F.filter("steps", lambda s: s["before"] < j), F.lit(0).cast("bigint"), lambda acc, s: acc + s["cnt"])
            ranks = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: j + F.coalesce(shift(j), F.lit(0)))
            wanted = queries.select("query_id", "qn").join(steps, "query_id", "left").select("query_id", "qn", F.explode(ranks).alias("rank"))
            found = wanted.join(placed, "rank").select("query_id", "qn", "cloud_id", "n")
            blocks.append(found if self.classes.blocks == 1 else materialize(found, "set-disjoint"))
        return blocks


def _measured(pairs: DataFrame, measure: SetMetric) -> DataFrame:
    return pairs.withColumn("distance", measure(F.col("shared"), F.col("qn"), F.col("n")))


def set_distances(points: DataFrame, qpoints: DataFrame, grid: GridParams, metric: str | SetMetric) -> DataFrame:
    """(query_id, cloud_id, shared, qn, n, distance) of the pairs that share a cell."""
    sets = _Sets(points, qpoints, grid)
    pairs = sets.classes.members([rows.select("query_id", "cloud_id", "shared", "qn", "n") for rows in sets.pairs()])
    return _measured(pairs, METRICS[metric] if isinstance(metric, str) else metric)


def set_knn(points: DataFrame, qpoints: DataFrame, grid: GridParams, k: int, metric: str | SetMetric, disjoint: str = "smaller") -> DataFrame:
    """(query_id, rank, cloud_id, distance): the k nearest of all sets, those without a shared cell included. Distances are shown
    to 9 places, and ranked as they are; angles by their cosines' squares, which are exact for equal ones.

    Where ids are whole numbers, shared cells are counted in arrays (``tallies``) for all sets at once, and the metric is worked out for all
    numbers that there can be, if they aren't more than ``MOST_CASES``. Otherwise pairs that share a cell come from a join on cells. The distance of others depends on their sizes alone, so only the
    first k of them can count. ``metric`` may be a function of (shared, size of the query, size of the cloud); ``disjoint`` then says
    which of the sets without a shared cell are nearer: the ``smaller`` ones, the ``larger`` ones, or all ``alike``.
    """
    check_k(k)
    named = {"hamming": "smaller", "angular": "alike", "jaccard": "alike"}
    if isinstance(metric, str) and metric not in METRICS or disjoint not in ("smaller", "larger", "alike"):
        raise ValueError(f"metric must be a function or one of {sorted(METRICS)}; disjoint smaller, larger or alike")
    measure, disjoint = (METRICS[metric], named[metric]) if isinstance(metric, str) else (metric, disjoint)
    exact = (lambda *x: -closeness(*x)) if metric == "angular" else measure
    shown = lambda ranked: _measured(ranked, measure).select("query_id", "rank", "cloud_id", F.round("distance", 9).alias("distance"))
    if countable((points, "cloud_id"), (qpoints, "query_id")):
        sets = _Sets(points, qpoints, grid, packed=True)
        if table := sets.table(exact(F.col("shared"), F.col("qn"), F.col("n"))):
            best = tallied(sets.classes, sets.cells.withColumn("cnt", F.lit(1)), nearest_sets(table, k), ["shared", "qn", "n"], named=True)
            return shown(sets.classes.nearest([_measured(rows, exact) for rows in best], "distance", k))
    sets = _Sets(points, qpoints, grid)
    names = ["query_id", "cloud_id", "distance", "n", "qn", "shared"]
    by = [F.asc("distance"), F.asc("cloud_id")]
    best = sets.pairs(lambda pairs: top(_measured(pairs, exact), ["query_id"], by, k).select(names))
    best = materialize(top(union(best), ["query_id"], by, k).select(names), "set-near")
    order = {"smaller": [F.asc("n"), F.asc("cloud_id")], "larger": [F.desc("n"), F.asc("cloud_id")], "alike": [F.asc("cloud_id")]}[disjoint]
    first = sets.sizes.agg((F.max if disjoint == "larger" else F.min)("n")).first()[0]
    none = F.lit(0).cast("bigint")
    last = best.groupBy("query_id").agg(F.count("*").alias("found"), F.max("distance").alias("last"))
    # the others have k answers nearer than any set without a shared cell
    nearer = (F.col("found") >= k) & (F.col("last") < exact(none, F.col("qn"), F.lit(first).cast("bigint")))
    queries = materialize(sets.queries.join(last, "query_id", "left").where(~F.coalesce(nearer, F.lit(False))).select("query_id", "qn"), "set-queries")
    fill = [] if queries.isEmpty() else [_measured(rows.withColumn("shared", none), exact).select(names) for rows in sets.first_disjoint(queries, k, order)]
    both = union([best, *fill])
    return shown(sets.classes.nearest([both], "distance", k))


def near_pairs(points: DataFrame, qpoints: DataFrame, grid: GridParams, metric: str | SetMetric = "angular", most: float = 0.1) -> DataFrame:
    """(query_id, near): how many clouds lie within ``most`` of each query, 0 included, whether they share a cell or not.

    Shared cells are counted in arrays as in ``set_knn``. Where that can't be, clouds without a shared cell are counted by size: all of a size are within ``most`` or none; those that do share one are taken
    off again. The sizes and their counts are one array, at most as long as the grid has cells.
    """
    measure = METRICS[metric] if isinstance(metric, str) else metric
    if countable((points, "cloud_id"), (qpoints, "query_id")):
        sets = _Sets(points, qpoints, grid, packed=True)
        if table := sets.table(F.when(measure(F.col("shared"), F.col("qn"), F.col("n")) <= most, 1)):
            near = tallied(sets.classes, sets.cells.withColumn("cnt", F.lit(1)), near_sets(table), ["near"], per_query=True, named=True)
            return union(near).groupBy("query_id").agg(F.sum("near").alias("near"))
    sets = _Sets(points, qpoints, grid)
    none = F.lit(0).cast("bigint")
    apart = measure(none, F.col("qn"), F.col("n")) <= most
    copies = lambda near: F.sum(F.when(near, F.col("copies")).otherwise(none))
    close = measure(F.col("shared"), F.col("qn"), F.col("n")) <= most
    blocks = sets.pairs(lambda pairs: pairs.groupBy("query_id").agg(copies(close).alias("__near"), copies(apart).alias("__off")))
    close = union(blocks).groupBy("query_id").agg(F.sum("__near").alias("__near"), F.sum("__off").alias("__off"))
    counts = sets.sizes.groupBy("n").agg(F.sum("copies").alias("cnt"))
    counts = counts.agg(F.collect_list(F.struct("n", "cnt")).alias("__sizes"))
    own = sets.queries.select("qn").distinct().join(F.broadcast(counts))  # one row
    total = F.aggregate(F.filter("__sizes", lambda s: measure(none, F.col("qn"), s["n"]) <= most), none, lambda acc, s: acc + s["cnt"])
    own = own.select("qn", total.alias("__all"))
    near = F.col("__all") + F.coalesce("__near", none) - F.coalesce("__off", none)
    return sets.queries.join(own, "qn").join(close, "query_id", "left").select("query_id", near.alias("near"))
