"""Every registered core query against its SQL, over whole tables."""

import duckdb
import pytest

from pointsim import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(queries.ORACLES[name])
    own = [d[0] for d in rel.description]
    assert sorted(own) == cols
    rows = rel.fetchall()
    want = sorted((tuple(r[own.index(c)] for c in cols) for r in rows), key=repr)
    assert got == want and got


def test_all_have_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()
