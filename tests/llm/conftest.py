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


SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a b"), (6, "A B"), (7, "a b c"), (7, "a b c"),
    (8, "x " * 5000), (9, "line one two\nline one two\n\n \nline one two"), (10, "éÉ あい \U0001f600 # * $ | <b>"),
    (11, "\x00 \x1c \x85     end"), (12, "tab\tand\nnew"), (13, " lead and trail "), (None, "no id here at all"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, odd and repeated texts, and a column whose name operators might use."""
    return spark.createDataFrame([(d, t, "en", None if d == 4 else "s", 0, "x") for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
