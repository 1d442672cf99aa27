"""Small cases by hand: cells, postings, votes, ties, recall."""

import pytest

from pointsim.functions import cell
from pointsim.operators import evaluate, postings, ranking, voting
from pointsim.params import FingerprintParams, GridParams, check_k
from pointsim.plans import CloudIndex

GRID = GridParams(100, 10)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cells(df, grid):
    return [r[0] for r in df.orderBy("point_id").select(cell(grid)).collect()]


def test_cells_and_their_aliases(cloud):
    points = cloud([(1, 0, 0), (1, 9.99, 10), (1, 100, 0), (1, 0, 10), (1, 35, 99)])
    assert cells(points, GRID) == [0, 10, 10, 10, 93]
    safe = cells(points, GridParams(100, 10, alias_safe=True))
    assert safe[2] != safe[3] and safe[1] == safe[3]
    assert cells(points, GridParams(100, 7)) == [0, 1 + 14, 14, 14, 5 + 14 * 14]


@pytest.mark.parametrize("bad", [(0, 1), (10, 0), (10, 11)])
def test_bad_grids(bad):
    with pytest.raises(ValueError):
        GridParams(*bad)


def test_other_bad_parameters():
    with pytest.raises(ValueError):
        FingerprintParams(limit=0)
    with pytest.raises(ValueError):
        check_k(0)


def test_bag_and_set_votes(cloud):
    points = cloud([(1, 1, 1), (1, 2, 2), (2, 3, 3), (3, 50, 50)])
    queries = cloud([(7, 5, 5), (7, 5, 5), (7, 55, 55), (8, 99, 99)], "query_id")
    bag = postings.bag_postings(points, GRID)
    assert rows(voting.grid_votes(bag, queries, GRID)) == [(7, 1, 4), (7, 2, 2), (7, 3, 1)]
    own = postings.set_postings(points, GRID)
    assert rows(voting.succinct_votes(own, queries, GRID)) == [(7, 1, 2), (7, 2, 2), (7, 3, 1)]
    assert rows(voting.succinct_votes(own, queries, GRID, literal_last_skip=True)) == [(7, 1, 2)]


def test_ties_go_to_the_smaller_id(cloud):
    points = cloud([(9, 1, 1), (4, 1, 1), (6, 1, 1)])
    queries = cloud([(1, 1, 1)], "query_id")
    index = CloudIndex("grid", points, GRID)
    assert rows(index.knn(queries, 2)) == [(1, 1, 4, 1), (1, 2, 6, 1)]
    assert rows(voting.most_voted(index.votes(queries))) == [(1, 4, 1)]
    assert index.name() == "Inverted grid"


def test_adding_clouds_equals_building_at_once(cloud):
    first, more = [(1, 1, 1), (2, 50, 50)], [(1, 2, 2), (3, 51, 51)]
    for kind in ("grid", "succinct"):
        assert rows(CloudIndex(kind, cloud(first), GRID).add(cloud(more)).table) == rows(CloudIndex(kind, cloud(first + more), GRID).table)


def test_posting_lists_and_bitmaps(cloud):
    own = postings.bag_postings(cloud([(3, 1, 1), (3, 2, 2), (1, 1, 1), (40000, 1, 1), (2, 50, 50)]), GRID)
    assert rows(postings.posting_lists(own)) == [(0, [1, 3, 3, 40000]), (55, [2])]
    assert rows(postings.ones_per_cell(own)) == rows(postings.bitmap_ones(postings.bitmaps(own))) == [(0, 3), (55, 1)]


def test_doubled_points_double_bag_votes_only(cloud):
    base = [(1, 1, 1), (2, 2, 2), (2, 50, 50)]
    queries = cloud([(1, 1, 1), (1, 50, 50)], "query_id")
    for kind, factor in (("grid", 2), ("succinct", 1)):
        once, twice = (rows(CloudIndex(kind, cloud(b), GRID).votes(queries)) for b in (base, base * 2))
        assert twice == [(q, c, factor * v) for q, c, v in once]


def test_recall_counts_unanswered_queries(spark, cloud):
    ranked = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 7, 5), (2, 2, 2, 4)], "query_id long, rank long, cloud_id long, votes long")
    queries = cloud([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)], "query_id")
    assert rows(evaluate.recall(ranked, queries, [1, 2, 10], 10)) == [(1, 0.25), (2, 0.5), (10, 0.5)]
    assert rows(evaluate.recall(ranked, queries, [1, 2], 10, "answered")) == [(1, 0.5), (2, 1.0)]
    assert rows(evaluate.recall(ranked.limit(0), queries, [1])) == [(1, 0.0)]
    with pytest.raises(ValueError):
        evaluate.recall(ranked, queries, [1, 10], 5)


def test_time_stats(spark):
    times = spark.createDataFrame([(1.0,), (3.0,)], "t double")
    assert rows(evaluate.time_stats(times, "t")) == [(2.0, 2.0**0.5, 1.0, 3.0)]
    assert rows(evaluate.time_stats(times.limit(1), "t"))[0][1] == 0.0


def test_report(cloud):
    points = cloud([(1, 1, 1), (2, 50, 50)])
    report = CloudIndex("grid", points, GRID).report(points.withColumnRenamed("cloud_id", "query_id"), 2, [1, 2], "ms", runs=2)
    assert report.recall_at == {1: 1.0, 2: 1.0} and len(report.times) == 2 and "recall@1: 1.0000" in str(report)


def test_plan_limits_groups_before_the_shuffle(cloud):
    points = cloud([(1, 1, 1)])
    plan = ranking.top_votes(CloudIndex("grid", points, GRID).votes(points.withColumnRenamed("cloud_id", "query_id")), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Python" not in text and "Cartesian" not in text
