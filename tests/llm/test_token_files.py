import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointsim.llm import token_cache, token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
FORM = T.Format(PATH, block_ids=500)


def want(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_whole_tables(docs, rows, odd):
    assert got(T.encode(docs, FORM)) == want(rows)
    assert got(T.encode(odd, FORM)) == want(ODD)
    assert got(T.encode(odd.limit(0), FORM)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**32 - 1), st.integers(32760, 32770)), min_size=1, max_size=200), min_size=1, max_size=6))
def test_round_trip(docs):
    block = T.Block(T.pack_block(list(range(len(docs))), [np.array(d, "<u4").tobytes() for d in docs]), 0)
    assert T.decode_words(block.words, block.escapes).tolist() == sum(docs, [])
    assert [block.doc(k).tolist() for k in range(len(docs))] == docs


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'srelvmtd.,é<|endoftext|>0123"), st.characters(codec="utf-8")), max_size=60))
def test_cached_ids_are_the_library_s(text):
    t = token_cache.encoder(PATH)
    assert t.encode(text).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_cache_and_batches():
    t = token_cache.Encoder(PATH, most=20)
    texts = ["", None, "a  b\n\n c", " the cat's 12 hats!?", "Ünï × text", "  ", "one two  three ", "ɏɐ x", "<|endoftext|> y"] * 3
    for _ in range(2):
        for n in (1, 4, 27):
            got = [x.tolist() for i in range(0, 27, n) for x in t.encode_many(pa.array(texts[i : i + n]))]
            assert got == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_files_are_cut_in_order(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    form = T.Format(PATH, block_ids=200, blocks_per_file=3)
    T.write(df, str(tmp_path / "t"), form)
    files = list((tmp_path / "t").glob("part-*"))
    assert len(files) > 20 and all(0 < len(list(T.file_blocks(f.read_bytes()))) <= 3 for f in files)
    assert got(T.index(spark, str(tmp_path / "t"))) == want(rows)
    out = T.encode(df, form).collect()
    assert len({r.file for r in out}) > 20 and len({(r.file, r.place) for r in out}) == len(out)
