"""Inverted index with positions: recall by phrases and ranking by BM25 over the whole corpus.

The index is a table of its own, made when rows are indexed and read by every search. It is stored in the order of its tokens,
so a search for some tokens reads only the row groups that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.durable import written
from terrane.functions.scores import bm25
from terrane.functions.text import analyze_terms, index_tokens, match_phrases
from terrane.tables import spread

#: Columns of the two indexes.
FILE_FIELDS = ("name", "path", "tags_text", "content_head", "search_text")
CHUNK_FIELDS = ("symbol", "language", "content", "search_text")


def postings(rows: DataFrame, fields: Sequence[str], id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """``token, id, field, pos`` and the columns ``keep``: each token of each field of each row; ids must be unique."""

    def of(n: int, field: str) -> Column:
        return F.transform(index_tokens(F.col(field)), lambda t, i: F.struct(t.alias("token"), F.lit(n).alias("field"), i.alias("pos")))

    each = [of(n, f) for n, f in enumerate(fields)]
    return rows.select(F.col(id).alias("id"), *keep, F.explode(F.concat(*each)).alias("p")).select("p.token", "id", "p.field", "p.pos", *keep)


def lengths(rows: DataFrame, fields: Sequence[str], id: str = "id") -> DataFrame:
    """``id, length``: the number of tokens of all fields of each row."""
    return rows.select(F.col(id).alias("id"), sum((F.size(index_tokens(F.col(f))) for f in fields), F.lit(0)).alias("length"))


def in_token_order(index: DataFrame, parts: int | None = None) -> DataFrame:
    """An index as it is to be stored: ranges of tokens, each sorted; a token with very many places falls into several ranges."""
    by_range = index.repartitionByRange("token", "id") if parts is None else index.repartitionByRange(parts, "token", "id")
    return by_range.sortWithinPartitions("token", "id", "field", "pos")


@dataclass(frozen=True)
class Index:
    """``postings`` (token, id, field, pos) and ``lengths`` (id, length) of the rows of a corpus."""

    postings: DataFrame
    lengths: DataFrame

    @staticmethod
    def of(rows: DataFrame, fields: Sequence[str], id: str = "id") -> Index:
        """An index that is computed where it is used."""
        return Index(postings(rows, fields, id), lengths(rows, fields, id))

    def stored(self, name: str) -> Index:
        """The same as tables in the shared folder."""
        return Index(written(in_token_order(self.postings), f"{name}-postings"), written(self.lengths, f"{name}-lengths"))


#: Up to so many tokens are named in the scan of an index; the tokens of more queries than that are joined with it.
MOST_NAMED = 10_000


def with_tokens(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of the tokens that are asked for."""
    tokens = asked.select("token").distinct()
    named = [r["token"] for r in tokens.limit(MOST_NAMED + 1).collect()]
    if len(named) > MOST_NAMED:
        return index.join(tokens, "token", "left_semi")
    return index.filter(F.col("token").isin(named))


def term_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``term, cf, df``: how often a term occurs, and in how many rows.

    Each row gives its terms once for each occurrence and once for itself, so both numbers are sums that are combined
    before the shuffle, and no row is sent anywhere.
    """
    terms = F.col("terms")  # a projection of its own, so that a text is analysed once
    each = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("row"))),
        F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("row"))),
    )
    counted = spread(rows.select(text)).select(analyze_terms(F.col(text)).alias("terms")).select(F.explode(each).alias("t")).select("t.term", "t.row")
    return counted.groupBy("term").agg(F.sum(1 - F.col("row")).alias("cf"), F.sum("row").alias("df"))


def query_phrases(queries: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """``query_id, phrase, token, offset, n``: the tokens of each phrase that a query asks for."""
    phrases = queries.select(F.col(query_id).alias("query_id"), F.posexplode(match_phrases(F.col(text))).alias("phrase", "t"))
    tokens = phrases.select("query_id", "phrase", F.size(index_tokens(F.col("t"))).alias("n"), F.posexplode(index_tokens(F.col("t"))).alias("offset", "token"))
    return tokens.filter("n > 0")


def phrase_hits(index: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, phrase, id, field, at``: where a phrase begins; its tokens stand there one after another."""
    hits = with_tokens(index, asked).join(asked, "token").withColumn("at", F.col("pos") - F.col("offset"))
    single = hits.filter("n = 1").select("query_id", "phrase", "id", "field", "at")
    several = hits.filter("n > 1").groupBy("query_id", "phrase", "id", "field", "at", "n").agg(F.count_distinct("offset").alias("m"))
    return single.unionByName(several.filter("m = n").select("query_id", "phrase", "id", "field", "at"))


def recalled(index: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """``query_id, id``: the rows with the lowest ids among those that hold any phrase, up to ``limit`` a query."""
    found = phrase_hits(index, asked).select("query_id", "id").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return found.withColumn("_r", place).filter(F.col("_r") <= limit).drop("_r")


def find(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, id, score``: rows that hold any phrase of a query, by BM25 with the phrases of the whole corpus.

    A phrase's frequency in a row is counted over all fields, and the row's length is the number of all its tokens.
    Queries without a searchable phrase find nothing.
    """
    asked = written(query_phrases(queries), "phrases")
    totals = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    frequency = written(phrase_hits(index.postings, asked).groupBy("query_id", "phrase", "id").agg(F.count(F.lit(1)).alias("tf")), "hits")
    holders = frequency.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("df"))
    scored = frequency.join(holders, ["query_id", "phrase"]).join(index.lengths, "id")
    weight = bm25(F.col("tf"), F.col("length"), F.lit(float(totals["average"] or 0.0)), F.lit(totals["n"]), F.col("df"))
    return scored.groupBy("query_id", "id").agg(F.sum(weight).alias("score"))


def snippets(tokens: Sequence[str]):
    """:func:`snippet` as a column expression, by Arrow batches."""
    wanted = list(tokens)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", wanted))

    return cut


def snippet(text: str, tokens: Sequence[str], width: int = 24) -> str:
    """The ``width`` tokens of a text that hold the most of the wanted ones, these in brackets, cut ends marked."""
    import re

    words = list(re.finditer(r"[^\W_]+", text))
    if not words:
        return ""
    wanted = {t.lower() for t in tokens}
    hit = [w.group().lower() in wanted for w in words]
    best, at = -1, 0
    count = sum(hit[:width])
    for i in range(max(1, len(words) - width + 1)):
        if count > best:
            best, at = count, i
        if i + width < len(words):
            count += hit[i + width] - hit[i]
    last = min(len(words), at + width)
    out, end = [], words[at].start()
    for k in range(at, last):
        w = words[k]
        out.append(text[end : w.start()])
        out.append(f"[{w.group()}]" if hit[k] else w.group())
        end = w.end()
    return ("…" if at else "") + "".join(out) + ("…" if last < len(words) else "")
