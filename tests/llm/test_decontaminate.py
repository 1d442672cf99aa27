import brute
import numpy as np
from conftest import ODD, SF

from pointsim.llm import decontaminate as D


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def want(docs, items):
    return sorted((d is None, d or 0, *rest) for d, *rest in brute.contamination(docs, items))


def test_against_brute_force(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert result(D.report(docs, bench)) == want(rows, items)
    assert result(D.report(docs, bench, D.Rules(block_words=100, shard_bytes=5000))) == want(rows, items)


def test_odd_texts_and_short_items(spark, odd):
    items = [(1, "x x x"), (2, "a b"), (2, "a b"), (3, None), (4, " "), (5, "line one two line"), (6, "end"), (10, "éÉ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(D.report(odd, bench)) == want(ODD, items)
    assert result(D.report(odd, bench.limit(0))) == want(ODD, [])
    assert D.report(odd.limit(0), bench).count() == 0
    assert D.filtered(odd, bench).columns == odd.columns


def test_longest_match(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "q r s " + " ".join(words[10:45]) + " z"), (2, " ".join(words[:12]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in D.matches(docs, bench).collect()] == [(1, "9", 3, 10, 35)]


def test_suffix_array():
    draw = np.random.Generator(np.random.PCG64(1))
    for words, size in ((2, 40), (3, 200), (50, 300)):
        n = draw.integers(0, 12, size)
        n[-1] = 60
        text = D.laid_out(draw.integers(1, words + 1, int(n.sum())), n)
        texts = "".join(chr(x) for x in text)
        want = sorted((k for k, x in enumerate(text) if x), key=lambda k: (texts[k : texts.index("\0", k)], k))
        assert D.suffix_array(text).tolist() == want


def test_blocks_are_bounded_and_one_is_held(spark):
    words = [f"w{i}" for i in range(3000)]
    items = [(1, " ".join(words)), (2, " ".join(words[:13])), *[(3, "same words here")] * 50]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rules = D.Rules(block_words=200)
    blocks = [b.value for b in D.build(bench, rules)]
    assert len(blocks) > 15 and all(len(b.text) <= 200 + len(b.first) for b in blocks)
    docs = spark.createDataFrame([(1, " ".join(words[180:230])), (2, "the same words here"), (3, " ".join(words[:12]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.longest_words) for r in D.report(docs, bench, rules).collect()}
    assert got[1][:2] == (50, 1) and got[1][2] >= 13 and got[2] == (3, 1, 3) and got[3] == (0, 0, 0)
    held = D.build(bench, rules)
    seen = 0
    for _ in D.each(held):
        seen += 1
        assert sum(hasattr(b, "_value") for b in held) == 1
    assert seen == len(held)


def test_arrays_serve_several_benchmarks(spark, docs, rows):
    shards = D.arrays(docs, D.Rules(shard_bytes=20_000))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    half = bench.where("item_id % 2 = 0")
    assert result(D.search(shards, bench)) == want(rows, items)
    assert result(D.search(shards, half)) == want(rows, [x for x in items if int(x[0]) % 2 == 0])


def test_longest_match_of_the_report(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    best = {}
    for r in D.matches(docs, bench).collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0, 0)), (r.n_words, -r.doc_word))
    got = {r.doc_id: (r.longest_words, -r.longest_at) for r in D.report(docs, bench).where("n_hit > 0").collect()}
    assert got == best and len(got) > 0
