import numpy as np
import public_tokenizers
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointsim.llm import token_counts as T
from pointsim.llm.token_cache import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
RULES = T.Rules(PATH)


def n_tokens(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return len(t.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for a, b, new in edits:
        a = min(max(a, 0), len(text))
        b = min(max(b, a), len(text))
        text = text[:a] + new + text[b:]
    return text


PIECES = st.sampled_from([" ", "  ", "\n", "\n\n ", "the", " cat", "'s", "'", "12", " 345", "é", "Ñandú", " ×", "あい", "<|endoftext|>", "!?", " ...", "longerwordhere", "\t", "\x0b", "\U0001f600", "l", "ve"])
TEXT = st.lists(PIECES, max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=8).map(" ".join), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 320), st.lists(PIECES, max_size=6).map("".join)), min_size=1, max_size=5))
def test_edits_against_whole_encoding(text, edits):
    made = encoder(PATH, plain_special=True)
    tree = T.Tree(text.encode(), T.measured(made, text.encode()))
    t = made.tokenizer
    want = text
    assert tree.tokens == len(t.encode(text, add_special_tokens=False).ids)
    for e in edits:
        tree.edit(made, *e)
        want = edited(want, [e])
        assert tree.text().decode() == want and tree.chars == len(want)
        assert tree.tokens == len(t.encode(want, add_special_tokens=False).ids)
        assert (tree.sums[1] == np.concatenate(tree.rows).sum(axis=0)).all()


def test_only_touched_regions_are_encoded(rows):
    made = encoder(PATH, plain_special=True)
    text = max((t for _, t in rows), key=len)
    tree = T.Tree(text.encode(), T.measured(made, text.encode()))
    tree.edit(made, len(text) // 2, len(text) // 2 + 5, "new")
    assert 0 < tree.encoded < 200 < len(text)
    again = T.load(tree.text(), tree.dump())
    assert again.tokens == tree.tokens == len(made.tokenizer.encode(tree.text().decode(), add_special_tokens=False).ids)


def changes(text):
    if text is None:
        return []
    n = len(text)
    return [(n // 4, n // 4 + 40, ""), (2 * n // 4, 2 * n // 4, " A sentence that wasn't here, of 12 words or so."), (3 * n // 4, 3 * n // 4 + 12, "re-written")]


def test_whole_tables(docs, rows, odd):
    for df, own in ((docs, rows), (odd, ODD)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.n_tokens, r.n_edits, r.n_chars_after, r.n_tokens_after) for r in T.counts(df, T.revision(), RULES).collect())
        after = [edited(t or "", changes(t)) for _, t in own]
        assert got == sorted((d is None, d or 0, len(t or ""), n_tokens(t or ""), len(changes(t)), len(x), n_tokens(x)) for (d, t), x in zip(own, after, strict=True))
    assert T.counts(odd.limit(0), T.revision(), RULES).count() == 0


def test_kept_trees(odd):
    built = T.build(odd, RULES)
    got = T.update(built, F.expr("array(struct(1L as start, 3L as end, 'zz' as text), null)"), RULES).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_tokens) for r in got) == sorted((d or 0, x, n_tokens(x)) for d, x in ((d, edited(t or "", [(1, 3, "zz")])) for d, t in ODD))
    assert {r.n_tokens for r in T.update(built, F.lit(None), RULES).where("doc_id = 1").collect()} == {0}
