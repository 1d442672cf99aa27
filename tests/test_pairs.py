"""Queries over pairs on copies of a table: the same rows as their SQL, and no shuffle that grows with the pairs."""

import time

import duckdb
import pytest

from pointsim import queries, storage
from pointsim.operators import intersect, pairs, postings, voting
from pointsim.params import GridParams

COPIES = 40
#: Over this table, of 40,000 points; pairs of clouds that meet are more than 300,000, those of points some millions.
MOST = 500_000
NAMES = [
    "igi_knn_top5", "igi_votes", "igi_knn_top1_mode", "igi_recall", "succinct_knn_top5", "succinct_knn_literal", "succinct_recall",
    "set_inner_product", "set_knn_angular", "set_knn_hamming", "set_knn_jaccard", "set_near_dup_count", "set_near_dup_hamming", "set_knn_dice", "set_recall",
    "box_support", "box_support_eps",
    "cell_knn_l2", "cell_knn_metric", "igirtree_knn_top5", "igivpt_knn_top5",
]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("copies"))
    shifted = f"SELECT event_id + 1000 * i AS event_id, ts, user_id + 15 * i AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range({COPIES}) t(i)"
    duckdb.execute(f"COPY ({shifted}) TO '{path}/events.parquet'")
    return path


def shuffled(spark) -> int:
    """Rows that shuffles have written so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", NAMES)
def test_copies(spark, copies, name):
    before = shuffled(spark)
    df = queries.QUERIES[name](spark, copies)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert shuffled(spark) - before < MOST
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{copies}/events.parquet'")
        rel = con.execute(queries.ORACLES[name])
        own = [d[0] for d in rel.description]
        assert got == sorted(tuple(r[own.index(c)] for c in cols) for r in rel.fetchall()) and got


@pytest.mark.parametrize("name", [n for n in NAMES if n in ("igi_votes", "igi_knn_top5", "set_knn_hamming", "box_support")])
def test_many_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 300)
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    with duckdb.connect() as con:
        con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
        rel = con.execute(queries.ORACLES[name])
        own = [d[0] for d in rel.description]
        assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[own.index(c)] for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name,most", [("cell_knn_metric", 140_000), ("igivpt_knn_top5", 150_000)])
def test_cells_points_are_shuffled_once(spark, copies, name, most):
    """Query points are dealt to their cells and counted there, and a cloud's neighbours at one distance are summed up there."""
    before = shuffled(spark)
    queries.QUERIES[name](spark, copies).collect()
    assert shuffled(spark) - before < most


@pytest.mark.parametrize("name,most", [("box_support", 60_000), ("set_inner_product", 100_000)])
def test_rows_are_shuffled_once(spark, copies, name, most):
    """Of 40,000 points on either side. Box pairs name clouds by sums made before the shuffle; sets need the distinct cells first."""
    before = shuffled(spark)
    queries.QUERIES[name](spark, copies).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < most


def test_shuffles_of_tables_are_removed(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}

    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(key)
    table = storage.materialize_tidily(spark.range(1000).repartition(3, "id"), "tidy")
    ends = time.time() + 20
    while files() - before and time.time() < ends:
        time.sleep(0.1)
    assert not files() - before and table.count() == 1000 and spark.conf.get(key) == set_before


def test_clouds_with_equal_numbers_of_other_points(spark):
    """Repeated points don't cancel out in a class's name."""
    rows = [(1, 1.0), (1, 1.0), (1, 5.0), (2, 9.0), (2, 9.0), (2, 5.0), (3, 1.0), (3, 5.0), (3, 1.0)]
    points = spark.createDataFrame([(i, x, 1.0) for i, x in rows], "cloud_id long, x double, y double")
    asked = spark.createDataFrame([(7, 1.0, 1.0), (8, 5.0, 1.0)], "query_id long, x double, y double")
    support = {tuple(r) for r in intersect.box_support(points, asked, 2).collect()}
    assert support == {(7, 1, 2, 3, 2 / 3), (7, 3, 2, 3, 2 / 3), (8, 1, 1, 3, 1 / 3), (8, 2, 1, 3, 1 / 3), (8, 3, 1, 3, 1 / 3)}


@pytest.mark.parametrize("name,most", [("igi_votes", 0.23), ("set_inner_product", 0.23), ("box_support", 0.32)])
def test_pairs_of_copies_take_little_room(spark, copies, tmp_path, name, most):
    """All rows of the SQL are written, but a class's clouds always in the same order. most: bytes a row."""
    queries.QUERIES[name](spark, copies).write.parquet(str(tmp_path / name))
    rows = spark.read.parquet(str(tmp_path / name)).count()
    assert sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")) < most * rows


@pytest.mark.parametrize("blocks", [1, 3])
def test_clouds_without_id_and_copies(spark, monkeypatch, blocks):
    """The cloud of rows without id has an equal one with an id; they stay two."""
    points = spark.createDataFrame([(None, 1.0, 1.0), (None, 2.0, 2.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (4, 1.0, 1.0), (4, 2.0, 2.0), (5, 1.0, 1.0), (5, 90.0, 90.0)], "cloud_id long, x double, y double")
    asked = spark.createDataFrame([(7, 1.0, 1.0), (7, 1.0, 2.0), (8, 95.0, 95.0)], "query_id long, x double, y double")
    if blocks > 1:
        monkeypatch.setattr(pairs, "BLOCK_ROWS", 2)
    grid = GridParams(100, 10)
    votes = {tuple(r) for r in voting.grid_votes(postings.bag_postings(points, grid), asked, grid).collect()}
    assert votes == {(7, None, 4), (7, 3, 4), (7, 4, 4), (7, 5, 2), (8, 5, 1)}
    support = {(r.query_id, r.cloud_id, r.hits) for r in intersect.box_support(points, asked, 3).collect()}
    assert support == {(7, 3, 4), (7, 4, 4), (7, 5, 2)}  # the SQL joins sizes by id
