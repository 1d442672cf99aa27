"""Extra columns whose names operators use themselves, and tables read from folders."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pointsim.llm import decontaminate, licenses, mixing, near, quality, queries, secrets, sharding, token_counts, token_files, warc

NAMES = "kept size hash nid node component family band bands salt pivot shard slot n_words probability whole threshold times taken p0 target units unit left n a b cls open state row found paragraphs spans file place start n_tokens offset word centre".split()
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def wide(docs):
    return docs.limit(60).select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES)).cache()


def test_rows_pass_with_all_columns(spark, wide):
    bench = spark.createDataFrame([(1, "w " * 13, "x")], "item_id long, text string, kept string")
    model = None
    for out in (quality.filtered(wide, model), near.filtered(wide), decontaminate.filtered(wide, bench), mixing.mixed(wide)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    assert sharding.assigned(wide).columns == [*wide.columns, "__shard"]


def test_reports_keep_their_own_names(spark, wide):
    n = wide.count()
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, text int")
    bench = spark.createDataFrame([(None, "w " * 13), (2, None)], "item_id long, text string")
    model = quality.fit(wide, labels)
    own = [
        quality.score(wide, model), near.classes(wide), decontaminate.report(wide, bench), mixing.plan(wide), sharding.slots(wide), secrets.find(wide),
        licenses.report(wide, licenses.fit(wide)), token_counts.counts(wide, token_counts.revision(), token_counts.Rules(PATH)), token_files.encode(wide, token_files.Format(PATH)),
    ]
    for df in own:
        assert df.count() == n and "own kept" not in {v for r in df.collect() for v in r}
    pages = spark.createDataFrame([(1, "u", "h" * 200, "x"), (2, "u", "h" * 200, "x")], "page_id long, url string, html string, payload string")
    assert warc.round_trip(pages).count() == 2


def test_all_null_columns(spark):
    none = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.kept for r in quality.score(none, None).collect()] == [False] * 3
    assert [r.component_id for r in near.classes(none).collect()] == [None] * 3
    assert [r.contaminated for r in decontaminate.report(none, bench).collect()] == [False] * 3
    assert [(r.size, r.target, r.taken) for r in mixing.plan(none).collect()] == [(0, 0.0, 0)] * 3
    assert sorted(r.slot for r in sharding.slots(none).collect()) == [0, 1, 2]
    assert [r.n_layers for r in secrets.find(none).collect()] == [0] * 3
    assert [(r.start, r.n_tokens) for r in token_files.encode(none, token_files.Format(PATH)).orderBy("start").collect()] == [(0, 1), (1, 1), (2, 1)]
    assert [r.n_tokens for r in token_counts.counts(none, token_counts.revision(), token_counts.Rules(PATH)).collect()] == [0] * 3
    assert [r.families for r in licenses.report(none, licenses.fit(none)).collect()] == [""] * 3


def test_very_long_text(spark):
    text = " ".join(f"word{k % 5000} a" for k in range(200_000))
    df = spark.createDataFrame([(1, text, "s"), (2, "x" * 2_000_000, "s")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "word1 a word2 a word3 a word4 a word5 a word6 a word7")], "item_id long, text string")
    assert {r.doc_id: r.n_words for r in quality.score(df, None).collect()} == {1: 400_000, 2: 1}
    assert {r.doc_id: r.n_shingles for r in near.classes(df, near.Rules(shingle=3, percent=85)).collect()} == {1: 10_000, 2: 1}
    assert {r.doc_id: r.n_hit for r in decontaminate.report(df, bench).collect()} == {1: 40 * 13, 2: 0}
    assert sum(r.size for r in sharding.slots(df).collect()) == len(text) + 2_000_000 + 2
    assert {r.doc_id: r.n_assign for r in secrets.find(df).collect()} == {1: 0, 2: 0}
    assert token_files.encode(df, token_files.Format(PATH)).count() == 2


def test_ten_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
    assert queries.oracle_sql().keys() <= queries.queries().keys()
