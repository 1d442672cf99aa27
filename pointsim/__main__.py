"""python -m pointsim INDEX.csv QUERIES.csv: index one file's clouds, search for the other's, print times and recall."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .params import GridParams
from .plans import KINDS, CloudIndex
from .sources import read_clouds_csv


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pointsim", description=__doc__)
    parser.add_argument("index")
    parser.add_argument("queries")
    parser.add_argument("--kind", choices=sorted(KINDS), default="grid")
    parser.add_argument("--cmax", type=int, default=10_000)
    parser.add_argument("--delta", type=int, default=10)
    parser.add_argument("-k", type=int, default=20)
    parser.add_argument("--internal-k", type=int, default=1)
    parser.add_argument("--at", type=int, nargs="+", default=[5, 10, 20])
    parser.add_argument("--unit", choices=("s", "ms", "us"), default="us")
    parser.add_argument("--no-header", action="store_true")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("pointsim").getOrCreate()
    read = lambda path: read_clouds_csv(spark, path, (0, own.cmax), header=not own.no_header)
    points = read(own.index)
    queries = read(own.queries).withColumnRenamed("cloud_id", "query_id")
    index = CloudIndex(own.kind, points, GridParams(own.cmax, own.delta), internal_k=own.internal_k)
    print(f"indexed points: {points.count()}, query points: {queries.count()}")
    print(index.report(queries, own.k, own.at, own.unit))


if __name__ == "__main__":
    main()
