"""Each stage against a plain version on its own input."""

from collections import Counter

import brute
import pytest
from conftest import SF
from test_token_files import got, want

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        if len(seen) <= len(corpus_pipeline.STAGES):
            assert seen[-1].columns == columns
    start, good, single, clean, mixed, tokens = seen
    start, good, single, clean, mixed = (plain(x.collect()) for x in (start, good, single, clean, mixed))
    base = {d for d, t in start if brute.quality(t)[-1]}
    assert set(good) < set(start) and not base & {d for d, _ in good}
    kept = {d for d, _, _, keep in brute.near(good, 5, 80) if keep}
    assert single == [x for x in good if x[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_, hit in brute.contamination(single, items) if hit}
    assert clean == [x for x in single if x[0] not in bad]
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2
    sizes = lambda x: sum(len(brute.SPACE_WORD.findall(t)) for _, t in x)
    assert abs(sizes(mixed) - 1.5 * sizes(clean)) < 0.1 * sizes(clean)  # sources of a few documents
    assert got(tokens) == want(mixed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_run_on_odd_tables(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; then empty tables."""
    from pyspark.sql import functions as F

    names = "kept hash nid node family times __times file place start".split()
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    long = " ".join(f"word{k} of it" for k in range(60_000))
    more = spark.createDataFrame([(10**6, long, "en", "s", 0), (None, None, None, None, None), (None, "some words without any id to go by here, more than ten", "en", None, 3)], base.schema)
    docs = base.union(base.limit(30)).union(more).union(odd.select(base.columns)).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for where, df in (("a", docs), ("b", docs.limit(0))):
        df.write.parquet(str(tmp_path / where / "documents.parquet"))
        for table in ("labels", "benchmark"):
            own = spark.read.parquet(f"{SF}/{table}.parquet")
            (own if where == "a" else own.limit(0)).write.parquet(str(tmp_path / where / f"{table}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert rows and max(Counter(r.doc_id for r in rows if r.doc_id is not None).values()) <= 2
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
