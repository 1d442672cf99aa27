"""Nearest points by every plan against brute force, and the cases that go wrong easily."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pointsim.functions import floor_l2, l2
from pointsim.operators import knn
from pointsim.params import GridParams
from pointsim.plans import CloudIndex


def brute(points, queries, k, metric):
    out = Counter()
    for q, qx, qy in queries:
        d = {"l2": lambda a, b: (qx - a) * (qx - a) + (qy - b) * (qy - b), "floor_l2": lambda a, b: int(((qx - a) * (qx - a) + (qy - b) * (qy - b)) ** 0.5)}[metric]
        for dist, c, x, y in sorted((d(x, y), c, x, y) for c, x, y in points)[:k]:
            out[q, qx, qy, c, x, y, dist] += 1
    return out


def found(df):
    out = Counter()
    for r in df.collect():
        out[r.query_id, r.qx, r.qy, r.cloud_id, r.x, r.y, r.distance] += r.taken * r.weight
    return out


def spread(n, seed, clusters=3):
    """Points in a few dense spots, far apart, with repeated and tied ones."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = [(50.0, 50.0), (9000.0, 100.0), (5000.0, 9900.0)][draw.randrange(clusters)]
        out.append((draw.randrange(6), a + draw.randrange(40), b + draw.randrange(40)))
    return out + [(8, 2500.5, 2500.5)] * 4


@pytest.mark.parametrize("strategy", ["grid", "vantage", "clusters"])
@pytest.mark.parametrize("metric", ["l2", "floor_l2"])
@pytest.mark.parametrize("k", [1, 4])
def test_all_plans_are_exact(cloud, strategy, metric, k):
    points, queries = spread(120, 1), [*spread(40, 2), (1, 0.0, 0.0), (1, 10000.0, 10000.0)]
    got = found(knn.point_knn(cloud(points), cloud(queries, "query_id"), k, metric, strategy))
    assert got == brute(points, queries, k, metric)


def test_fewer_points_than_k_and_none(cloud):
    points, queries = [(1, 5.0, 5.0), (2, 6.0, 6.0)], [(9, 5.0, 5.0)]
    for strategy in ("grid", "vantage", "clusters"):
        assert found(knn.point_knn(cloud(points), cloud(queries, "query_id"), 5, strategy=strategy)) == brute(points, queries, 5, "l2")
        assert knn.point_knn(cloud(points).limit(0), cloud(queries, "query_id"), 5, strategy=strategy).count() == 0
        assert knn.point_knn(cloud(points), cloud(queries, "query_id").limit(0), 5, strategy=strategy).count() == 0
    with pytest.raises(ValueError):
        knn.point_knn(cloud(points), cloud(queries, "query_id"), 0)


def test_own_cell_only(cloud):
    points = [(1, 9.0, 9.0), (2, 11.0, 11.0), (3, 1.0, 1.0)]
    queries = [(7, 9.9, 9.9), (8, 95.0, 95.0)]
    grid = GridParams(100, 10)
    got = knn.cell_knn(cloud(points), cloud(queries, "query_id"), grid, 1)
    assert [(r.query_id, r.cloud_id) for r in got.collect()] == [(7, 1)]
    same = [knn.knn_votes(knn.cell_knn(cloud(points), cloud(queries, "query_id"), grid, 2, m)) for m in (l2, floor_l2)]
    assert sorted(map(tuple, same[0].collect())) == [(7, 1, 1), (7, 3, 1)] == sorted(map(tuple, same[1].collect()))


def test_kinds_agree(cloud):
    points, queries = cloud(spread(90, 3)), cloud(spread(30, 4), "query_id")
    votes = [sorted(map(tuple, CloudIndex(kind, points, internal_k=2).knn(queries, 3).collect())) for kind in ("rtree", "vpt", "revlc")]
    assert votes[0] == votes[1] == votes[2] and votes[0]


def test_plans_join_on_keys(cloud):
    points = cloud(spread(50, 5))
    plan = knn.cell_knn(points, points.withColumnRenamed("cloud_id", "query_id"), GridParams(), 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_centres_and_radii(cloud):
    points = cloud([(1, 0, 0), (1, 3, 4), (2, 10, 0), (2, 5, 0)])
    assigned = knn.assign_centres(points, [(0.0, 0.0), (10.0, 0.0)])
    assert [(r.centre, r.distance) for r in assigned.orderBy("point_id").collect()] == [(0, 0.0), (0, 5.0), (1, 0.0), (0, 5.0)]
    assert sorted(map(tuple, knn.covering_radii(assigned).collect())) == [(0, 5.0, 3), (1, 0.0, 1)]


METRICS = {
    "l1": (lambda qx, qy, x, y: F.abs(qx - x) + F.abs(qy - y), lambda qx, qy, x, y: abs(qx - x) + abs(qy - y)),
    "max": (lambda qx, qy, x, y: F.greatest(F.abs(qx - x), F.abs(qy - y)), lambda qx, qy, x, y: max(abs(qx - x), abs(qy - y))),
    "whole": (lambda qx, qy, x, y: F.greatest(F.abs(F.floor(qx) - F.floor(x)), F.abs(F.floor(qy) - F.floor(y))), lambda qx, qy, x, y: max(abs(qx // 1 - x // 1), abs(qy // 1 - y // 1))),
}


@pytest.mark.parametrize("name", sorted(METRICS))
@pytest.mark.parametrize("strategy", ["vantage", "clusters"])
def test_any_metric(cloud, name, strategy):
    column, plain = METRICS[name]
    points, queries = spread(100, 6), [*spread(30, 7), (1, 0.0, 0.0)]
    want = Counter()
    for q, qx, qy in queries:
        for dist, c, x, y in sorted((plain(qx, qy, x, y), c, x, y) for c, x, y in points)[:3]:
            want[q, qx, qy, c, x, y, dist] += 1
    assert found(knn.point_knn(cloud(points), cloud(queries, "query_id"), 3, column, strategy)) == want


def test_metric_is_used_or_refused(cloud):
    points, queries = cloud([(1, 0.0, 5.0), (2, 4.0, 4.0)]), cloud([(7, 0.0, 0.0)], "query_id")  # by the largest coordinate 2 is nearer
    column = METRICS["max"][0]
    for kind in ("vpt", "revlc", "bkt", "grid_vpt", "grid_rtree"):
        assert CloudIndex(kind, points, metric=column).knn(queries, 1).first().cloud_id == 2
    assert CloudIndex("vpt", points).knn(queries, 1).first().cloud_id == 1
    for kind in ("rtree", "grid", "succinct", "fingerprint", "set_hamming"):
        with pytest.raises(ValueError):
            CloudIndex(kind, points, metric=column)
    with pytest.raises(ValueError):
        knn.point_knn(points, queries, 1, column, "grid")
    with pytest.raises(ValueError):
        CloudIndex("grid", points, plan="grid")


def test_nearly_all_points_in_one_place(cloud):
    draw = random.Random(8)
    points = [(k % 7, 5000 + draw.random(), 5000 + draw.random()) for k in range(990)] + [(9, draw.random() * 10_000, draw.random() * 10_000) for _ in range(10)]
    queries = [(k, 5000 + draw.random(), 5000 + draw.random()) for k in range(60)] + [(99, draw.random() * 10_000, draw.random() * 10_000) for _ in range(5)]
    for strategy in ("grid", "vantage"):
        assert found(knn.point_knn(cloud(points), cloud(queries, "query_id"), 2, "l2", strategy)) == brute(points, queries, 2, "l2")
    table = cloud(points)
    side = knn._side(knn._index(table, 2), knn._plane, 10_000.0, 16.0)
    assert max(r["count"] for r in table.groupBy(F.floor(F.col("x") / side), F.floor(F.col("y") / side)).count().collect()) < 100


@pytest.mark.parametrize("hot", [False, True])
def test_pairs_are_ranked_where_they_meet(spark, cloud, monkeypatch, hot):
    """More query points than indexed ones: their pairs leave the task of their cell only if a cell has too many."""
    if hot:
        monkeypatch.setattr(knn, "HOT_ROWS", 0)
    plans, nearest = [], knn._nearest

    def watched(pairs, by, k):
        plans.append(nearest(pairs, by, k)._jdf.queryExecution().executedPlan().toString())
        return nearest(pairs, by, k)

    monkeypatch.setattr(knn, "_nearest", watched)
    points, queries = spread(60, 5), [*spread(300, 6), (1, 0.0, 0.0), (1, 10000.0, 10000.0)]
    monkeypatch.setattr(knn, "TASK_ROWS", 50)
    got = found(knn.point_knn(cloud(points), cloud(queries, "query_id"), 3))
    assert got == brute(points, queries, 3, "l2")
    assert ("hashpartitioning(query_id" in plans[0]) == hot


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("strategy", ["grid", "vantage", "clusters", "cell", "cell l1"])
def test_merged_rows(cloud, strategy, many):
    """Repeated query points, and points of a cloud at one distance, with more and with fewer query points than indexed ones."""
    points = [(1, 5.0, 5.0), (1, 7.0, 5.0), (1, 6.0, 4.0), (2, 6.0, 6.0), *spread(40, 9)]
    queries = [(3, 6.0, 5.0)] * 3 + [(4, 6.0, 5.0), (4, 55.0, 60.0)] + spread(120 if many else 5, 10)
    a, b, grid = cloud(points), cloud(queries, "query_id"), GridParams(10_000, 100)
    if strategy.startswith("cell"):
        rows, merged = (knn.cell_knn(a, b, grid, 4, METRICS["l1"][0] if "l1" in strategy else l2, m) for m in (False, True))
    else:
        rows, merged = (knn.point_knn(a, b, 4, strategy=strategy, merged=m) for m in (False, True))
    want, weights = Counter(), Counter((q, x, y) for q, x, y in queries)
    for r in rows.collect():
        want[r.query_id, r.qx, r.qy, r.weight, r.cloud_id, r.distance] += r.taken
        assert r.weight == weights[r.query_id, r.qx, r.qy]
    got = [tuple(r) for r in merged.collect()]
    assert sorted(got) == sorted((*key, n) for key, n in want.items()) and max(r[-1] for r in got) > 1
    assert merged.columns == [*knn.QUERY, *knn.MERGED]
