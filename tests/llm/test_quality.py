import math

import brute
import numpy as np
import pyarrow as pa
from conftest import ODD, SF

from pointsim.llm import common as C
from pointsim.llm import quality


def base(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_measures_against_brute_force(docs, rows, odd):
    for df, own in ((docs, rows), (odd, ODD)):
        assert base(quality.score(df, None)) == sorted(((d is None, d or 0), *brute.quality(t)) for d, t in own)


def test_model_on_rows_held_out(spark):
    """Rows that were neither fitted nor used to calibrate; of the junk only what the base rules pass."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality.Rules(max_rows=600)
    seen = {r.doc_id for r in quality.sample(docs, labels, rules).collect()}
    model = quality.fit(docs, labels, rules)
    got = quality.score(docs, model, rules).join(labels, "doc_id").toPandas()
    got = got[~got.doc_id.isin(seen) & ~got.base_failed]
    junk, clean = got[got.quality == 0], got[got.quality == 1]
    assert len(seen) == 600 and len(junk) > 50 and len(clean) > 500
    assert (~junk.kept).mean() > 0.95 and clean.kept.mean() > 0.98
    # calibrated for classes of equal size: a small Brier score, and about half of them good
    assert (junk.probability**2).mean() / 2 + ((1 - clean.probability) ** 2).mean() / 2 < 0.05
    assert 0.4 < junk.probability.mean() / 2 + clean.probability.mean() / 2 < 0.6


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} " * 50) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 40 % 2) for k in range(400)], "doc_id long, quality int")
    rules = quality.Rules(max_rows=10, max_chars=60)
    rows = quality.sample(docs, labels, rules).collect()
    assert len(rows) == 10 and {len(r.text) for r in rows} == {60} and len({r.doc_id for r in rows}) == 10
    assert sorted(quality.sample(docs.union(docs), labels, rules).collect()) == sorted(rows)


# ---------------------------------------------------------------- a plain scorer
def plain_hash(data):
    total = 0
    for k, byte in enumerate(data):
        total += int(C.BYTE_CODES[byte]) * pow(int(C.STEP), k, 1 << 64)
    return plain_mix(total % (1 << 64))


def plain_mix(h):
    h ^= h >> 31
    h = h * 0x9E3779B97F4A7C15 % (1 << 64)
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
    return h ^ h >> 32


def plain_probability(text, model):
    words = [plain_hash(w.encode()) for w in brute.SPACE_WORD.findall(text)]
    pairs = []
    for a, b in zip(words, words[1:], strict=False):
        h = (a * 0x9E3779B97F4A7C15 + b) % (1 << 64)
        pairs.append(plain_mix(h ^ h >> 29))
    chars = [plain_hash(text[k : k + 4].encode()) for k in range(len(text) - 3)]
    mean = lambda own, part: sum(int(model.weights[part + (h >> 64 - quality.BITS)]) for h in own) / quality.ONE / max(len(own), 1)
    score = model.slope * (model.bias + mean([*words, *pairs], 0) + mean(chars, quality.SIZE)) + model.shift
    return 1 / (1 + math.exp(-max(-50, min(50, score))))


def test_probability_and_verdict_against_a_plain_scorer(spark, docs, rows, odd):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for df, own in ((docs, [(d, t) for d, t in rows if len(t or "") < 3000]), (odd, ODD)):
        got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.score(df, model).collect()}
        for d, t in own:
            n, chars, *_, failed = brute.quality(t)
            p = plain_probability(t or "", model)
            r = got[d, n, chars]
            assert abs(r.probability - p) < 1e-9 and r.kept == (not failed and p >= quality.Rules().threshold)
    mine = quality.filtered(docs, model).select("doc_id").collect()
    assert sorted(r.doc_id for r in mine) == sorted(r.doc_id for r in quality.score(docs, model).where("kept").collect())


def test_no_model_without_both_classes(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, none) is None
    assert quality.train(pa.array(["a"] * 20), np.ones(20)) is None


def test_empty_and_columns(spark, odd):
    assert quality.score(odd.limit(0), None).count() == 0
    kept = quality.filtered(odd, None)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {8, 9, 10, 11}


def test_short_texts_at_the_end_of_a_batch():
    model = quality.Model(np.ones(2 * quality.SIZE, np.int32), 0.0, 1.0, 0.0)
    for texts in ([""], ["abc"], ["a b c d", ""], ["abcd", "é"], ["abcde", "", None, "xy"]):
        got = quality.measure(*C.utf8(pa.array(texts)), model, quality.Rules())
        assert all(abs(p - plain_probability(t or "", model)) < 1e-12 for p, t in zip(got[-2], texts, strict=True))
