from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbstone.llm.tokens import VOCABULARY, Encoder, encode_corpus, model_bytes, read_vocabulary, serialise_model

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def enc():
    return Encoder(model_bytes())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(spark, small, public):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(docs).collect()}
    ids = sorted(texts)
    assert got == dict(zip(ids, public([texts[i] or "" for i in ids]), strict=True))


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text(enc, public, texts):
    got = enc.encode(texts)
    assert got == public(texts)
    assert [enc.decode(i) for i in got] == texts


def test_long_and_special(enc, public):
    texts = ["a" * 200_000, "<|endoftext|>", " \n\n\t  x", "▁▁<unk><s>", "\x00\x1c \x85​", "é" * 3000 + " " * 5000, "don't I'LL we've"]
    got = enc.encode(texts)
    assert got == public(texts)
    assert [enc.decode(i) for i in got] == texts


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "a", 5)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()]
    ab, a = Encoder(model_bytes()).encode(["a b", "a"])
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, ab), (3, ab), (None, a)], key=str)
    assert encode_corpus(df.limit(0)).count() == 0


def test_incomplete_vocabulary_is_refused(tmp_path):
    with pytest.raises(ValueError):
        serialise_model([b"a", b"b"])
    (tmp_path / "v").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        read_vocabulary(str(tmp_path / "v"))
