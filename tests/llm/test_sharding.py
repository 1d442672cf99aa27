import math

import brute
import xxhash
from conftest import ODD

from pointsim.llm import sharding as S


def winner(doc_id, n, seed=5):
    """The same draw: 64-bit hashes of the parts as little-endian integers, each seeded by the last."""
    draws = []
    for k in range(n):
        h = 42
        if doc_id is not None:
            h = xxhash.xxh64_intdigest((doc_id % (1 << 64)).to_bytes(8, "little"), h)
        for x in (seed, k):
            h = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), h)
        draws.append((-math.log(((h >> 11) + 0.5) / 2.0**53), k))
    return min(draws)[1]


def check(df, own, n=8):
    got = df.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 1, brute.crc(t), winner(d, n), winner(d, n + 1)) for d, t in own)
    for k in range(n):
        mine = sorted(r.slot for r in got if r.shard == k)
        assert mine == list(range(len(mine)))
    assert all(r.grown_shard in (r.shard, n) and r.law == "key" for r in got)


def test_whole_tables(docs, rows, odd):
    check(S.slots(docs), rows)
    check(S.slots(docs, S.Rules(range_rows=3)), rows)
    check(S.slots(odd), ODD)
    assert S.slots(odd.limit(0)).count() == 0
    assert S.assigned(odd).columns == [*odd.columns, "__shard"]


def test_weights(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = {r["__shard"]: r["count"] for r in S.assigned(df, S.Rules(weights=(1.0, 3.0))).groupBy("__shard").count().collect()}
    assert abs(n[1] / 20000 - 0.75) < 0.02


def test_copies_of_one_row_are_dealt_in_pieces(spark):
    rows = [(1, "copy")] * 5000 + [(None, None)] * 3000 + [(k, f"t{k}") for k in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(S.slots(df, S.Rules(range_rows=64)), rows)
