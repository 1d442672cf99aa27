"""Pairs counted in arrays: the rows of the SQL where no two clouds are alike, and no rows for pairs on the way."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pointsim import queries
from pointsim.operators import cellsets, pairs, postings, tallies, voting
from pointsim.params import GridParams

COPIES = 40
#: Of 40,000 points and 600 clouds, the pairs of which are 360,000; a join on cells makes far more rows.
MOST = 200_000
NAMES = [
    "igi_knn_top5", "igi_knn_top1_mode", "igi_recall", "succinct_knn_top5", "succinct_knn_literal", "succinct_recall",
    "set_knn_angular", "set_knn_hamming", "set_knn_jaccard", "set_knn_dice", "set_recall", "set_near_dup_count", "set_near_dup_hamming",
]
GRID = GridParams(100, 10)


def shuffled(spark) -> int:
    """Rows that shuffles have written so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def others(tmp_path_factory):
    """Copies of the events with other users, so that no two clouds are alike."""
    path = str(tmp_path_factory.mktemp("others"))
    shifted = f"SELECT event_id + 1000 * i AS event_id, ts, (hash(event_id, i) % 15)::BIGINT + 15 * i AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range({COPIES}) t(i)"
    duckdb.execute(f"COPY ({shifted}) TO '{path}/events.parquet'")
    return path


def rows_made(spark) -> int:
    """The most rows that a node of any plan has made so far."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        values, metrics = store.executionMetrics(runs.apply(i).executionId()), runs.apply(i).metrics()
        for j in range(metrics.size()):
            if metrics.apply(j).name() == "number of output rows" and values.contains(metrics.apply(j).accumulatorId()):
                most = max(most, int(values.apply(metrics.apply(j).accumulatorId()).replace(",", "").split("\n")[0]))
    return most


@pytest.mark.parametrize("name", NAMES)
def test_clouds_that_differ(spark, others, name):
    df = queries.QUERIES[name](spark, others)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{others}/events.parquet'")
        rel = con.execute(queries.ORACLES[name])
        own = [d[0] for d in rel.description]
        assert got == sorted(tuple(r[own.index(c)] for c in cols) for r in rel.fetchall()) and got


def test_no_rows_for_pairs(others):
    """In a session of its own, as the plans' figures are kept by it."""
    import os
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from pointsim import queries
from tests.test_tallies import MOST, NAMES, rows_made
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in NAMES:
    queries.QUERIES[name](spark, {others!r}).write.format("noop").mode("overwrite").save()
    assert rows_made(spark) < MOST, (name, rows_made(spark))
assert rows_made(spark) >= 40_000
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("rows,at_once,few", [(400_000, 1 << 22, 8), (3, 2, 1)])
def test_votes_against_brute_force(spark, monkeypatch, rows, at_once, few):
    """Ids that are null or below 0, points and query points that repeat, equal clouds, cells of one side only; blocks and pieces of a few rows."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", rows)
    monkeypatch.setattr(pairs, "PACKED", 4)
    monkeypatch.setattr(tallies, "AT_ONCE", at_once)
    monkeypatch.setattr(tallies, "FEW", few)
    draw = random.Random(9)
    ids = [None, -3, 0, *range(5, 14)]
    points = [(i, draw.randrange(40) * 1.0, draw.randrange(30) * 1.0) for i in ids for _ in range(draw.randrange(1, 30))]
    points += [(20, x, y) for i, x, y in points if i == 7] + [(-8, x, y) for i, x, y in points if i is None]
    asked = [(i, draw.randrange(60) * 1.0, draw.randrange(30) * 1.0) for i in ids for _ in range(draw.randrange(1, 60))] + [(99, 95.0, 95.0)]
    of = lambda x, y: (x // 10, y // 10)
    here = Counter((i, of(x, y)) for i, x, y in points)
    want = Counter()
    for (q, c), n in Counter((i, of(x, y)) for i, x, y in asked).items():
        for (i, d), m in here.items():
            if c == d:
                want[q, i] += n * m
    place = lambda i: (i is not None, i or 0)
    best = set()
    for q in {q for q, _ in want}:
        mine = sorted(((-v, place(i), i) for (p, i), v in want.items() if p == q))[:4]
        best |= {(q, k, i, -v) for k, (v, _, i) in enumerate(mine, 1)}
    table = spark.createDataFrame(points, "cloud_id long, x double, y double")
    query = spark.createDataFrame(asked, "query_id int, x double, y double")
    found = voting.top_voted(postings.bag_postings(table, GRID), query, GRID, 4)
    assert {tuple(r) for r in found.collect()} == best and found.schema["query_id"].dataType.simpleString() == "int"
    # the same by rows of a join, for ids of other kinds
    named = voting.top_voted(postings.bag_postings(table.where("cloud_id is not null").withColumn("cloud_id", F.format_string("%05d", F.col("cloud_id") + 100)), GRID), query, GRID, 4)
    counted = voting.top_voted(postings.bag_postings(table.where("cloud_id is not null"), GRID), query, GRID, 4)
    assert {(r[0], r[1], int(r[2]) - 100, r[3]) for r in named.collect()} == {tuple(r) for r in counted.collect()}


@pytest.mark.parametrize("metric,disjoint", [("angular", "alike"), ("hamming", "smaller"), ("odd", "larger")])
def test_sets_by_arrays_and_by_rows(spark, monkeypatch, metric, disjoint):
    """Ranks and counts of near sets are the same where the metric can't be worked out beforehand."""
    draw = random.Random(10)
    ids = [None, -3, *range(12)]
    points = [(i, draw.randrange(60) * 1.0, draw.randrange(60) * 1.0) for i in ids for _ in range(draw.randrange(1, 12))]
    points += [(30, x, y) for i, x, y in points if i == 7]
    asked = [(i, draw.randrange(80) * 1.0, draw.randrange(60) * 1.0) for i in ids[1:] for _ in range(draw.randrange(1, 12))]
    table = spark.createDataFrame(points, "cloud_id long, x double, y double")
    query = spark.createDataFrame(asked, "query_id long, x double, y double")
    own = (lambda shared, a, b: F.when(shared > 0, F.lit(0.0)).otherwise(F.lit(100.0) - b)) if metric == "odd" else metric
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 10)
    monkeypatch.setattr(pairs, "PACKED", 2)
    rows = lambda: (sorted(tuple(r) for r in cellsets.set_knn(table.where("cloud_id is not null"), query, GRID, 5, own, disjoint).collect()), sorted(tuple(r) for r in cellsets.near_pairs(table, query, GRID, own, 1.3).collect()))
    arrays = rows()
    monkeypatch.setattr(cellsets, "MOST_CASES", 0)
    assert rows() == arrays and len(arrays[0]) == 5 * 13 and len(arrays[1]) == 13


def test_clusters_sort_only_what_is_near(spark, others):
    """Of 40,000 points on either side: the first rings give a bound without a sort, and what is farther away is left out before one."""
    before = shuffled(spark)
    queries.QUERIES["point_knn_clusters"](spark, others).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 340_000
