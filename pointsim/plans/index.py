"""One class for all kinds of index; what differs is the table it keeps and the plan that answers."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import floor_l2, l2_squared
from ..functions.distance import PointMetric, SetMetric
from ..operators.cellsets import set_knn
from ..operators.evaluate import recall
from ..operators.fingerprints import fingerprint_votes, fingerprints
from ..operators.intersect import box_support
from ..operators.knn import cell_knn, knn_votes, point_knn
from ..operators.postings import bag_postings, merged, set_postings
from ..operators.ranking import top_votes
from ..operators.voting import grid_votes, ones, succinct_votes, top_voted
from ..params import FingerprintParams, GridParams, check_k
from ..storage import materialize

#: Kind -> name in reports, and what it votes by.
KINDS = {
    "grid": "Inverted grid",
    "succinct": "Succinct inverted grid",
    "rtree": "Point neighbours, grid plan",
    "vpt": "Point neighbours, vantage plan",
    "bkt": "Point neighbours, whole-number distance",
    "revlc": "Point neighbours, cluster plan",
    "grid_rtree": "Cell neighbours",
    "grid_vpt": "Cell neighbours, any metric",
    "fingerprint": "Constellation fingerprints",
    "set_angular": "Cell sets, angular distance",
    "set_hamming": "Cell sets, Hamming distance",
    "set_jaccard": "Cell sets, Jaccard distance",
    "set": "Cell sets, any metric",
}
#: The plan of each kind that searches all points.
PLANS = {"rtree": "grid", "vpt": "vantage", "bkt": "grid", "revlc": "clusters"}
ANY_METRIC = ("vpt", "revlc", "bkt", "grid_rtree", "grid_vpt", "set")
UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6}


@dataclass(frozen=True)
class PerformanceReport:
    """Recall at each k and the times of batches, a query's share each."""

    name: str
    unit: str
    recall_at: dict[int, float]
    times: list[float] = field(default_factory=list)

    @property
    def average(self) -> float:
        return sum(self.times) / len(self.times)

    @property
    def sd(self) -> float:
        n = len(self.times)
        return (sum((t - self.average) ** 2 for t in self.times) / (n - 1)) ** 0.5 if n > 1 else 0.0

    def __str__(self) -> str:
        rows = [f"{self.name}", f"time a query ({self.unit}): average {self.average:.3f}, sd {self.sd:.3f}, max {max(self.times):.3f}, min {min(self.times):.3f}"]
        return "\n".join(rows + [f"recall@{k}: {r:.4f}" for k, r in sorted(self.recall_at.items())])


class CloudIndex:
    """An index of clouds. ``points``: (cloud_id, x, y); queries: (query_id, x, y).

    All neighbour kinds answer alike under one metric; ``plan`` (grid, vantage, clusters) overrides how. ``metric``: a function of
    columns, for points (qx, qy, x, y) of kinds vpt, revlc, bkt, grid_rtree and grid_vpt, for sets (shared, size, size) of kind ``set``;
    ``disjoint`` as in ``set_knn``. The other kinds have a metric of their own, and take none.
    """

    def __init__(self, kind: str, points: DataFrame, grid: GridParams = GridParams(), prints: FingerprintParams = FingerprintParams(), internal_k: int = 1, metric: PointMetric | SetMetric | None = None, index_zone: str = "closed", query_zone: str = "open", literal_last_skip: bool = False, plan: str | None = None, disjoint: str = "smaller"):
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        if metric is not None and kind not in ANY_METRIC:
            raise ValueError(f"kind {kind} has a metric of its own")
        if kind == "set" and metric is None:
            raise ValueError("kind set needs a metric")
        if plan is not None and kind not in PLANS:
            raise ValueError(f"a plan is for kinds {sorted(PLANS)}")
        self.disjoint = disjoint
        self.kind, self.grid, self.prints, self.internal_k = kind, grid, prints, check_k(internal_k)
        self.plan = plan
        self.metric, self.index_zone, self.query_zone, self.literal_last_skip = metric, index_zone, query_zone, literal_last_skip
        self.table = materialize(self._built(points), f"index-{kind}")

    def _built(self, points: DataFrame) -> DataFrame:
        if self.kind == "grid":
            return bag_postings(points, self.grid)
        if self.kind == "succinct":
            return set_postings(points, self.grid)
        if self.kind == "fingerprint":
            return fingerprints(points, self.prints, self.index_zone)
        return points.select("cloud_id", "x", "y")

    def name(self) -> str:
        return KINDS[self.kind]

    def add(self, points: DataFrame) -> CloudIndex:
        """Index more clouds, or more points of clouds on a grid; fingerprints of a cloud are made of all its points at once."""
        fresh = self._built(points)
        if self.kind == "grid":
            table = merged(self.table, fresh)
        elif self.kind == "succinct":
            table = self.table.unionByName(fresh).distinct()
        else:
            table = self.table.unionByName(fresh)
        self.table = materialize(table, f"index-{self.kind}")
        return self

    def votes(self, queries: DataFrame) -> DataFrame:
        """(query_id, cloud_id, votes)."""
        if self.kind == "grid":
            return grid_votes(self.table, queries, self.grid)
        if self.kind == "succinct":
            return succinct_votes(self.table, queries, self.grid, self.literal_last_skip)
        if self.kind == "fingerprint":
            return fingerprint_votes(self.table, queries, self.prints, self.query_zone)
        if self.kind in ("grid_rtree", "grid_vpt"):
            return knn_votes(cell_knn(self.table, queries, self.grid, self.internal_k, self.metric or l2_squared, merged=True))
        if self.kind.startswith("set"):
            raise ValueError("sets are ranked by distance, not votes")
        metric = "floor_l2" if self.kind == "bkt" and self.metric is None or self.metric is floor_l2 else self.metric
        metric = "l2" if metric is None or metric is l2_squared else metric
        # coordinates bound the named metrics only
        plan = self.plan or ("vantage" if self.kind == "bkt" and not isinstance(metric, str) else PLANS[self.kind])
        return knn_votes(point_knn(self.table, queries, self.internal_k, metric, plan, merged=True))

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, cloud_id, votes), or distance instead of votes for sets."""
        if self.kind.startswith("set"):
            return set_knn(self.table, queries, self.grid, k, self.metric or self.kind[4:], self.disjoint)
        if self.kind in ("grid", "succinct"):
            return top_voted(self.table if self.kind == "grid" else ones(self.table, self.literal_last_skip), queries, self.grid, k)
        return top_votes(self.votes(queries), k)

    def intersection(self, queries: DataFrame, delta: float, epsilon: float = 0.0, ordered: bool = True) -> DataFrame:
        """Box support of every cloud; for kinds that keep points. ordered: by support, which shuffles all that is found."""
        if self.kind in ("grid", "succinct", "fingerprint"):
            raise ValueError("this kind keeps no points")
        found = box_support(self.table, queries, delta, epsilon)
        return found.orderBy(F.desc("support"), "cloud_id") if ordered else found

    def report(self, queries: DataFrame, k: int, at: list[int] = [1], unit: str = "us", runs: int = 1, denominator: str = "all") -> PerformanceReport:  # noqa: B006
        n = max(queries.select("query_id").distinct().count(), 1)
        times, found = [], None
        for _ in range(max(runs, 1)):
            began = time.perf_counter()
            found = materialize(self.knn(queries, k), "ranked")
            times.append((time.perf_counter() - began) * UNITS[unit] / n)
        rows = recall(found, queries, at, k, denominator).collect()
        return PerformanceReport(self.name(), unit, {r.k: r.recall for r in rows}, times)
