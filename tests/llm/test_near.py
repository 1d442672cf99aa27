import random

import brute
import pytest
from conftest import ODD

from pointsim.llm import near as N

RULES = N.Rules(shingle=3, percent=85)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_against_brute_force(docs, rows):
    assert result(N.classes(docs, RULES)) == sorted(brute.near(rows))


def family(n, seed, words=120):
    """A base text and copies at all distances, and unrelated texts."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(9999)}" for _ in range(words)]
    out = [(0, " ".join(base))]
    for k in range(1, n):
        own = list(base)
        for _ in range(draw.randrange(0, 9)):
            own[draw.randrange(words)] = f"x{draw.randrange(9999)}"
        out.append((k, " ".join(own)))
    return out + [(n + k, " ".join(f"y{draw.randrange(9999)}" for _ in range(40))) for k in range(20)]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_large_family_in_chunks_and_rounds(spark, seed):
    rows = family(160, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rules in (RULES, N.Rules(shingle=3, percent=85, chunk=16, pivots=12)):
        assert result(N.classes(df, rules)) == sorted(brute.near(rows))


def test_odd_texts(spark, odd):
    got = N.classes(odd, RULES).collect()
    assert len(got) == len(ODD)
    own = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None)
    assert own == sorted(brute.near([x for x in ODD if x[0] is not None]))
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(3, None, True)]
    kept = N.filtered(odd, RULES)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13)] + [(True, 0)]
    assert N.classes(odd.limit(0), RULES).count() == 0
