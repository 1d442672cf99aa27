"""CSV rules, stores, streams and the command line."""

import pytest

from pointsim.__main__ import main
from pointsim.operators.postings import bag_postings
from pointsim.params import GridParams
from pointsim.sources import load_postings, read_clouds_csv, save_postings, write_clouds_csv
from pointsim.streaming import append_postings, read_postings

GRID = GridParams(100, 10)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("ID, X, Y\n0, 1238.5 ,1234.75\n0,nan,5\n1,-1,5\n1,10001,5\n\n2.9,0,10000\n3,7,8")
    got = read_clouds_csv(spark, str(path))
    assert rows(got.drop("point_id")) == [(0, 1238.5, 1234.75), (2, 0.0, 10000.0), (3, 7.0, 8.0)]
    assert read_clouds_csv(spark, str(path), bounds=None).count() == 6


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("ID,X,Y\n1,2,3\n4,5\n6,x,7\n")
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        read_clouds_csv(spark, str(path)).collect()
    assert rows(read_clouds_csv(spark, str(path), mode="DROPMALFORMED").drop("point_id")) == [(1, 2.0, 3.0)]


@pytest.mark.parametrize("kind", ["parquet", "orc"])
def test_postings_survive_the_disk(spark, cloud, tmp_path, kind):
    own = bag_postings(cloud([(1, 1, 1), (1, 2, 2), (2, 50, 50)]), GRID)
    save_postings(own, str(tmp_path / kind), kind)
    assert rows(load_postings(spark, str(tmp_path / kind), kind)) == rows(own)
    with pytest.raises(ValueError):
        save_postings(own, "x", "csv")


def test_stream_appends_once(spark, cloud, tmp_path):
    source = str(tmp_path / "in")
    more = [[(1, 1, 1), (2, 50, 50)], [(1, 2, 2)]]
    for batch in more:
        cloud(batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(cloud(batch).schema).parquet(source)
        for _ in range(2):  # nothing new the second time
            append_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck"), GRID).awaitTermination()
    assert rows(read_postings(spark, str(tmp_path / "out"))) == rows(bag_postings(cloud(sum(more, [])), GRID))


def test_command_line(spark, cloud, tmp_path, capsys):
    points = cloud([(1, 1, 1), (2, 50, 50), (2, 60, 60)])
    write_clouds_csv(points, str(tmp_path / "c"))
    main([str(tmp_path / "c"), str(tmp_path / "c"), "--kind", "set_jaccard", "-k", "2", "--at", "1", "2"])
    out = capsys.readouterr().out
    assert "indexed points: 3" in out and "recall@1: 1.0000" in out
