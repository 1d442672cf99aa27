import duckdb
import pytest
from conftest import ODD, SF

from pointsim.llm import mixing as M


def result(df):
    return sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(M.ORACLE).fetchall())
    got = result(M.plan(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == want and got == result(M.plan(spark.read.parquet(f"{sf}/documents.parquet").repartition(3)))


def test_budgets(spark):
    rows = M.plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (by.target <= 2 * by["size"] + 1e-6).all() and (rows.taken <= 2 * rows["size"]).all()
    assert ((by.taken - by.target).abs() <= 0.01 * by.target).all()


def test_odd_texts(spark, odd):
    got = M.plan(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert {r.source for r in got if r.doc_id == 4} == {None}
    assert M.mixed(odd).columns == odd.columns
    assert M.mixed(odd).count() == sum(r.times for r in got)
    assert M.plan(odd.limit(0)).count() == 0


def test_none_is_taken_more_than_the_limit(spark):
    rows = [(k, "", "a") for k in range(39)] + [(39, "a b c d e", "a")] + [(100 + k, "x " * (k % 7), "b") for k in range(60)] + [(k, None, None) for k in range(200, 240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r.doc_id: r["count"] for r in M.mixed(df).groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 2 and all(r.times <= 2 and r.taken <= 2 * r.size for r in M.plan(df).collect())


def test_many_sources(spark):
    """Weights go by the sources' order, whatever ranges they are dealt in."""
    rows = [(k, "w " * (1 + k * 7919 % 13), f"host{k % 700:04d}" if k % 701 else None) for k in range(3000)]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string, source string").toPandas())
    want = sorted((a, b, c, round(d, 6)) for a, b, c, d, _ in con.execute(M.ORACLE).fetchall())
    got = M.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got.collect()) == want
