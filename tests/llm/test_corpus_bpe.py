import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import corpus_bpe as cb

pytestmark = pytest.mark.skipif(not os.path.exists(cb.VOCABULARY), reason="no vocabulary file here")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="'relvstmdE aÄ1-\n\t\r中🙂\u0301", min_size=1, max_size=60), st.data())
def test_joins_are_exact_whatever_the_cuts(text, data):
    enc = cb._encoder(cb.VOCABULARY)
    cuts = sorted(data.draw(st.sets(st.integers(0, len(text)), max_size=4)) | {0, len(text)})
    parts = [cb.encode_chunk(enc, text[a:b].encode(), data.draw(st.integers(1, 6))) for a, b in zip(cuts, cuts[1:])]
    assert cb.joined(enc, parts) == enc.encode_ordinary(text)


def test_chunks_are_content_defined():
    rng = np.random.default_rng(0)
    body = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    cut = lambda b: cb.chunks_of(b, cb.cut_points(np.frombuffer(b, np.uint8)))
    a, b = cut(body), cut(b"some words before " + body)
    assert b"".join(a) == body and len(set(a) & set(b)) > 0.8 * len(a)
    assert max(map(len, cut("é".encode() * 20_000))) <= cb.MOST and all(c.decode() for c in cut("é".encode() * 20_000))


def test_table(spark):
    texts = [None, "", " ", "hello world", "<|endoftext|>", "it's\r\n\r\n we'll", "a" * 20_000, "naïve café 中文 " * 400, "same passage, twice. " * 60]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(8, texts[8], "y"), (None, "hello world", "z")]
    got = sorted(((r.doc_id, r.ids) for r in cb.encode(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()), key=lambda r: (r[0] is None, r[0]))
    enc = cb._encoder(cb.VOCABULARY)
    want = [(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(8, enc.encode_ordinary(texts[8])), (None, enc.encode_ordinary("hello world"))]
    assert got == want
    assert all(enc.decode(ids) == (texts[i] or "") for i, ids in got if i is not None)


def test_both_libraries_agree(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(cb.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in cb.encode(docs).collect()} == want


def test_empty_table(spark):
    assert cb.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
