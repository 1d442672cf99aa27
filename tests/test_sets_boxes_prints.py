"""Cell sets, box support and fingerprints, by hand and by brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pointsim.operators import cellsets, fingerprints, intersect
from pointsim.params import FingerprintParams, GridParams
from pointsim.plans import CloudIndex

GRID = GridParams(100, 10)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_disjoint_sets_are_ranked_too(cloud):
    # cloud 1 shares one of its many cells with the query; 2 is small and shares none
    points = cloud([(1, x * 10, 0) for x in range(9)] + [(2, 0, 90)] + [(3, 0, 80), (3, 10, 80)])
    queries = cloud([(7, 0, 0)], "query_id")
    assert rows(cellsets.set_knn(points, queries, GRID, 3, "hamming")) == [(7, 1, 2, 2.0), (7, 2, 3, 3.0), (7, 3, 1, 8.0)]
    angle = rows(cellsets.set_knn(points, queries, GRID, 3, "angular"))
    assert [r[2] for r in angle] == [1, 2, 3] and angle[1][3] == round(math.pi / 2, 9)
    assert rows(cellsets.set_knn(points, queries, GRID, 3, "jaccard"))[0] == (7, 1, 1, round(1 - 1 / 9, 9))


@pytest.mark.parametrize("metric", ["angular", "hamming", "jaccard"])
def test_sets_against_brute_force(cloud, metric):
    draw = random.Random(5)
    points = [(c, draw.randrange(100), draw.randrange(100)) for c in range(25) for _ in range(draw.randrange(1, 12))]
    queries = [(c, draw.randrange(100), draw.randrange(100)) for c in range(9) for _ in range(draw.randrange(1, 30))]
    own = lambda p: {c: {(x // 10, y // 10) for i, x, y in p if i == c} for c in {r[0] for r in p}}
    a, b = own(queries), own(points)
    d = {"angular": lambda i, m, n: 0.0 if i / (math.sqrt(m) * math.sqrt(n)) >= 1 else math.acos(i / (math.sqrt(m) * math.sqrt(n))), "hamming": lambda i, m, n: float(m + n - 2 * i), "jaccard": lambda i, m, n: 1 - i / (m + n - i)}[metric]
    want = []
    for q, s in a.items():
        best = sorted((round(d(len(s & t), len(s), len(t)), 9), c) for c, t in b.items())[:4]
        want += [(q, k, c, dist) for k, (dist, c) in enumerate(best, 1)]
    assert rows(CloudIndex(f"set_{metric}", cloud(points), GRID).knn(cloud(queries, "query_id"), 4)) == sorted(want)


def test_equal_sets_have_distance_zero(cloud):
    points = [(1, x, y) for x in range(0, 100, 10) for y in (0, 30, 70)]
    for metric in cellsets.METRICS:
        (got,) = rows(cellsets.set_knn(cloud(points), cloud(points, "query_id"), GRID, 1, metric))
        assert got == (1, 1, 1, 0.0)
    assert rows(cellsets.near_pairs(cloud(points), cloud([*points, (2, 99, 99)], "query_id"), GRID)) == [(1, 1), (2, 0)]


def test_boxes_hold_their_border_and_support_may_pass_one(cloud):
    points = cloud([(1, 5, 5), (1, 50, 50), (2, 10, 10)])
    queries = cloud([(7, 10, 10), (7, 0, 0), (7, 10, 0)], "query_id")
    got = rows(intersect.box_support(points, queries, 10))
    assert got == [(7, 1, 3, 2, 1.5), (7, 2, 1, 1, 1.0)]
    assert rows(intersect.box_support(points, queries, 10, 1.0)) == [(7, 1, 3, 2, 1.5)]
    with pytest.raises(ValueError):
        intersect.box_support(points, queries, 10, -1)


def test_boxes_against_brute_force(cloud):
    draw = random.Random(6)
    points = [(draw.randrange(5), draw.uniform(0, 100), draw.uniform(0, 100)) for _ in range(150)]
    queries = [(draw.randrange(4), draw.uniform(0, 100), draw.uniform(0, 100)) for _ in range(80)]
    want = Counter((q, c) for q, qx, qy in queries for c, x, y in points if abs(x - qx) <= 3.5 and abs(y - qy) <= 3.5)
    assert {(r.query_id, r.cloud_id): r.hits for r in intersect.box_hits(cloud(points), cloud(queries, "query_id"), 7).collect()} == want


PRINTS = FingerprintParams(delta_x=10, delta_y=10, limit=2)


def test_zone_borders(cloud):
    points = cloud([(1, 10, 20), (1, 20, 20), (1, 15, 25), (1, 15, 24), (1, 3, 4), (1, 5, 4)])
    pairs = lambda zone, p=PRINTS: sorted((r.ax, r.ay, r.px, r.py) for r in fingerprints.zone_pairs(points, p, zone).collect() if (r.ax, r.ay) != (r.px, r.py))
    assert pairs("open") == [(10, 20, 15, 24), (15, 24, 20, 20)]
    # the closed zone has its border; the point at (15, 25) and (15, 24) see (20, 20), and each other at a distance of 0
    assert pairs("closed") == [(10, 20, 15, 24), (10, 20, 15, 25), (10, 20, 20, 20), (15, 24, 15, 25), (15, 24, 20, 20), (15, 25, 15, 24), (15, 25, 20, 20)]
    clipped = FingerprintParams(delta_x=10, delta_y=10, clip_bottom=True)
    assert (3, 4, 5, 4) in pairs("open", clipped)


def test_limit_takes_the_first_by_x_and_counts_copies(cloud):
    points = cloud([(1, 0, 50), (1, 5, 50), (1, 3, 51), (1, 3, 51), (1, 2, 52)])
    prints = {(r.y1, r.y2, r.dx): r.cnt for r in fingerprints.fingerprints(points, PRINTS, "open").collect()}
    assert prints[50, 52, 2] == 1 and prints[50, 51, 3] == 1 and (50, 50, 5) not in prints


def test_prints_against_brute_force(cloud):
    draw = random.Random(7)
    points = [(c, draw.randrange(60), draw.randrange(60)) for c in range(4) for _ in range(60)]
    for zone in ("open", "closed"):
        inside = (lambda dx, dy: 0 < dx < 10 and dy < 5) if zone == "open" else (lambda dx, dy: 0 <= dx <= 10 and dy <= 5)
        want = Counter()
        for c, ax, ay in points:
            if ay >= 5:
                own = sorted((x, y) for d, x, y in points if d == c and inside(x - ax, abs(y - ay)))
                for x, y in own[: PRINTS.limit]:
                    want[c, ay, y, x - ax] += 1
        got = {(r.cloud_id, r.y1, r.y2, r.dx): r.cnt for r in fingerprints.fingerprints(cloud(points), PRINTS, zone).collect()}
        assert got == want


def test_fingerprints_find_a_shifted_cloud(cloud):
    draw = random.Random(8)
    points = [(c, draw.randrange(200), draw.randrange(200)) for c in range(6) for _ in range(50)]
    moved = [(c, x + 37, y) for c, x, y in points]
    index = CloudIndex("fingerprint", cloud(points), prints=FingerprintParams(delta_x=30, delta_y=30))
    best = {r.query_id: r.cloud_id for r in index.knn(cloud(moved, "query_id"), 1).collect()}
    assert best == {c: c for c in range(6)}


def test_near_counts_sets_without_a_shared_cell(cloud):
    points = [(1, 5.0, 5.0), (2, 15.0, 15.0), *[(3, 10.0 * k + 5, 95.0) for k in range(9)]]
    both = cloud([(1, 5.0, 5.0), (2, 15.0, 15.0)])
    queries = cloud([(1, 5.0, 5.0), (2, 15.0, 15.0)], "query_id")
    assert rows(cellsets.near_pairs(both, queries, GRID, "hamming", 4)) == [(1, 2), (2, 2)]
    assert rows(cellsets.near_pairs(cloud(points), queries, GRID, "hamming", 4)) == [(1, 2), (2, 2)]
    assert rows(cellsets.near_pairs(cloud(points), queries, GRID, "jaccard", 1.0)) == [(1, 3), (2, 3)]
    assert rows(cellsets.near_pairs(cloud(points).limit(0), queries, GRID, "hamming", 4)) in ([], [(1, 0), (2, 0)])


def test_sets_by_any_metric_and_exact_ranks(cloud):
    points = [(1, 5.0, 5.0), *[(2, 10.0 * k + 5, 95.0) for k in range(4)], *[(3, 10.0 * k + 5, 85.0) for k in range(2)]]
    queries = cloud([(7, 5.0, 5.0)], "query_id")
    metric = lambda shared, a, b: F.when(shared > 0, F.lit(0.0)).otherwise(F.lit(100.0) - b)
    got = rows(cellsets.set_knn(cloud(points), queries, GRID, 3, metric, "larger"))
    assert got == [(7, 1, 1, 0.0), (7, 2, 2, 96.0), (7, 3, 3, 98.0)]
    with pytest.raises(ValueError):
        cellsets.set_knn(cloud(points), queries, GRID, 3, "other")
    # cosines that differ in the tenth place only
    close = lambda shared, a, b: F.lit(1.0) - shared * F.lit(1e-12) + a * F.lit(0.0) + b * F.lit(0.0)
    points = [(1, 5.0, 5.0), (2, 5.0, 5.0), (2, 15.0, 5.0)]
    assert [r[2] for r in rows(cellsets.set_knn(cloud(points), cloud([(7, 5.0, 5.0), (7, 15.0, 5.0)], "query_id"), GRID, 2, close, "alike"))] == [2, 1]
