import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.functions import text as X


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*(c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("S参数", ["s", "参数"]),
        ("S 参数", ["s", "参数"]),
        ("参数索引", ["参数", "数索", "索引"]),
        ("中", ["中"]),
        ("HybridSearch load_vector-candidates 384", ["hybridsearch", "load_vector-candidates", "384"]),
        ("", []),
        (None, []),
        ("??? ...", []),
    ],
)
def test_terms(spark, text, terms):
    assert one(spark, text, X.analyze_terms)[0] == terms


def test_phrases_of_a_query(spark):
    assert one(spark, "hybrid retrieval", X.match_phrases)[0] == ["hybrid", "retrieval"]
    assert one(spark, "what is it", X.match_phrases)[0] == []
    assert one(spark, "??? --- ...", X.match_phrases)[0] == []
    assert one(spark, "测量S参数", X.match_phrases)[0] == ["测量", "s", "参数"]
    assert one(spark, "参数索引", X.match_phrases)[0] == ["参数索引", "参数", "数索", "索引"]


def test_search_column(spark):
    words = one(spark, "测量S参数的方法", X.segment_index)[0].split()
    assert {"测量", "参数", "数的", "的方", "方法"} <= set(words) and "s" not in words
    assert one(spark, "only latin", X.segment_index)[0] == ""


def test_distinct_keeps_the_first(spark):
    got = one(spark, "参数 索引 参数 测量 索引", lambda c: X.distinct_terms(X.analyze_terms(c)))[0]
    assert got == ["参数", "索引", "测量"]


def test_snippets_end_at_a_character(spark):
    assert one(spark, "事务索引与检索", lambda c: X.compact_snippet(c, 7))[0] == "事务…"
    assert one(spark, "  short \n", lambda c: X.compact_snippet(c, 7))[0] == "short"
    assert one(spark, None, lambda c: X.compact_snippet(c, 7))[0] == ""


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=30), st.integers(0, 40))
def test_truncation(spark, text, limit):
    text = text.encode("utf-8", "ignore").decode()
    got = one(spark, text, lambda c: X.truncate_utf8(c, limit))[0]
    assert got == text.encode()[:limit].decode("utf-8", "ignore")


def test_headings_and_markup(spark):
    note = "## 3.1 分支预测\n## 本章概要\n#### deep\n```\ncode\n```\n# 一、Title (x)  \n"
    assert one(spark, note, X.headings)[0] == ["分支预测", "一、Title (x)"]
    plain = one(spark, "# A `b` **c** [d](e) <b>f</b> $x$ \\alpha{y}\n- g\n1. h", X.strip_markdown)[0]
    assert plain.split() == ["A", "c", "d", "f", "g", "h"]


def test_concept_words(spark):
    assert one(spark, "数据 and 的 x 缓存", X.concept_words)[0] == ["数据", "and", "缓存"]


def test_folding(spark):
    assert one(spark, "Café-Crème Straße ÉTÉ", X.index_tokens)[0] == ["cafe", "creme", "straße", "ete"]
