import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inundata.llm import queries
from inundata.llm.pieces import PieceCodec, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL, capacity=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abet ▁\n\téß<>0x"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_equals_library(text):
    codec = test_equals_library.codec
    joined, n, decoded = codec.encode_text(text)
    want = codec.library.encode(text)
    assert joined == ",".join(map(str, want)) and n == len(want)
    assert decoded == codec.library.decode(want)


test_equals_library.codec = PieceCodec(MODEL, capacity=50)


def test_spaces_and_runs(codec):
    for text in (" ", "  ", " " * 37, "a" + " " * 21 + "b", "▁", "▁▁ x", "\n\n", "x\n y", "the the  the"):
        want = codec.library.encode(text)
        assert codec.encode_text(text)[0] == ",".join(map(str, want)), text
        assert codec.encode_text(text)[2] == codec.library.decode(want), text


def test_query_equals_library(spark, sf_dir, codec):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = codec.library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()


def test_odd_inputs(spark, odd_docs, no_docs, codec):
    got = encode_pieces(odd_docs, MODEL, with_ids=True).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in got:
        assert r.ids == codec.library.encode(texts[r.doc_id]) and r.decoded == codec.library.decode(r.ids)
    assert encode_pieces(no_docs, MODEL).count() == 0
