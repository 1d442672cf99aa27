import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def cloud(spark):
    """(id, x, y) rows as a table of clouds or of queries."""

    def make(rows, key="cloud_id"):
        return spark.createDataFrame([(int(i), k, float(x), float(y)) for k, (i, x, y) in enumerate(rows)], f"{key} long, point_id long, x double, y double")

    return make
