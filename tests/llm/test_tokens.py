import os

import pytest

from terrane.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")

TEXTS = [
    "", " ", "\n\n  \n", "Hello world, it's 2025!", "we'll  see\t\ttabs\r\nand lines", "<|endoftext|> is plain", "的方法和 S参数", "👩‍💻 ½ ² é é \u3000x", "a" * 5000, "naïve café ﬁ", "x = {'a': [1,2,3]}\n    return x\n", "\x00\x1c\x85 odd",
]


def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T._encoder(f.read())


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 7, "block_docs": 2}])
def test_equals_encoding_whole_texts(spark, sizes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (3, TEXTS[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS block", "'w' AS word", "array(1) AS codes")
    got = sorted(((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in T.encode_corpus(df, **sizes).collect()))
    want = sorted((i is None, i or 0, encoder().encode_ordinary(t or "")) for i, t in rows)
    assert got == want


def test_agrees_with_the_other_library(spark):
    path = os.path.join(os.path.dirname(T.VOCABULARY), "byte_bpe_50k.json")
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    for t in TEXTS:
        assert other.encode(t, add_special_tokens=False).ids == encoder().encode_ordinary(t)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in T.decode_corpus(T.encode_corpus(df)).collect()}
    assert back == {i: t for i, t in enumerate(TEXTS)} | {99: ""}


def test_empty_table_and_decoding_of_what_is_missing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.encode_corpus(df).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [99_999_999]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in T.decode_corpus(ids).collect()} == {1: None, 2: "", 3: ""}


def test_the_whole_small_corpus(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in T.encode_corpus(df).collect()}
    assert got == {i: encoder().encode_ordinary(t) for i, t in texts.items()}
