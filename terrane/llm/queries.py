"""Registered queries of this subpackage, and the SQL that an independent engine runs for them where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import cooccurrence, handwritten, language, leakage, neighbours, ranking, secrets, splitting, tokens
from terrane.tables import table


def _cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.cooccurrence(table(spark, d, "concept_occurrences"), items=table(spark, d, "concepts"), baskets=table(spark, d, "chunks"))


def strong_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs that occur together at least eight times as often as chance says."""
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("n_ab", "n", "n_a", "n_b")}  # products go beyond 64 bits
    strong = exact["n_ab"] * exact["n"] >= exact["n_a"] * exact["n_b"] * 8
    return pairs.filter(strong)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return strong_pairs(_cooccurrence(spark, d)).select(F.col("item_a").alias("concept_a"), F.col("item_b").alias("concept_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _cooccurrence(spark, d).select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


_P1 = """
WITH occ AS (
  SELECT DISTINCT o.concept_id AS c, o.chunk_id AS k FROM concept_occurrences o
  WHERE o.concept_id IN (SELECT id FROM concepts) AND o.chunk_id IN (SELECT id FROM chunks)),
total AS (SELECT count(DISTINCT k) AS n FROM occ),
one AS (SELECT c, count(*) AS n_c FROM occ GROUP BY c),
two AS (SELECT a.c AS item_a, b.c AS item_b, count(*) AS n_ab FROM occ a JOIN occ b ON a.k = b.k AND a.c < b.c GROUP BY ALL HAVING count(*) >= 5),
full_ AS (
  SELECT item_a, item_b, x.n_c AS n_a, y.n_c AS n_b, n_ab, n
  FROM two JOIN one x ON x.c = item_a JOIN one y ON y.c = item_b CROSS JOIN total),
llr AS (
  SELECT *, n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) AS lift,
    2 * (n_ab * ln(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b))
      + CASE WHEN n_a > n_ab THEN (n_a - n_ab) * ln((n_a - n_ab)::DOUBLE * n / (n_a::DOUBLE * (n - n_b))) ELSE 0 END
      + CASE WHEN n_b > n_ab THEN (n_b - n_ab) * ln((n_b - n_ab)::DOUBLE * n / (n_b::DOUBLE * (n - n_a))) ELSE 0 END
      + CASE WHEN n - n_a - n_b + n_ab > 0 THEN (n - n_a - n_b + n_ab) * ln((n - n_a - n_b + n_ab)::DOUBLE * n / ((n - n_a)::DOUBLE * (n - n_b))) ELSE 0 END) AS llr
  FROM full_)
"""


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).filter("ordinal = 0").select("chunk_id", "boundary")


_P2 = """
WITH big AS (SELECT DISTINCT id, content FROM chunks WHERE length(content) > 1200),
lines AS (
  SELECT id, i, line, length(line) + CASE WHEN i < n THEN 1 ELSE 0 END AS size,
         regexp_full_match(line, '[ \\t\\r]*') AS blank
  FROM (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i,
               len(string_split(content, chr(10))) AS n FROM big)),
runs AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS stretch FROM lines),
worst AS (
  SELECT id, max(total) AS stretch, max(longest) AS line FROM (
    SELECT id, stretch, sum(CASE WHEN blank THEN 0 ELSE size END) AS total, max(CASE WHEN blank THEN 0 ELSE size END) AS longest
    FROM runs GROUP BY ALL) GROUP BY id)
SELECT id AS chunk_id, CASE WHEN stretch <= 1200 THEN 'blank' WHEN line <= 1200 THEN 'line' ELSE 'inside' END AS boundary FROM worst
"""


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk put together again from its pieces, with what holds for all of them."""
    pieces = p2_pieces(spark, d)
    own = F.expr("substring(piece, n_overlap + 1)")
    one = pieces.groupBy("chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", own.alias("own")))).alias("parts"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("symbol").alias("symbol"),
        F.count_distinct(F.coalesce("symbol", F.lit(""))).alias("n_symbols"),
        (F.max(F.char_length("piece")) <= 1200).alias("within_limit"), (F.max("n_overlap") <= 200).alias("within_overlap"),
    )
    return one.select("chunk_id", F.array_join("parts.own", "").alias("content"), "start_line", "end_line", "symbol", "n_symbols", "within_limit", "within_overlap")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_items(ranking.fuse_scores(table(spark, d, "search_hits"))).select("query_id", "file_id")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.fuse_scores(table(spark, d, "search_hits"))
    return fused.select("query_id", "file_id", (F.round("fused", 6) + 0.0).alias("fused"), "n_known")


def _percentile(score: str) -> str:
    known = f"{score} IS NOT NULL AND NOT isnan({score})"
    return (
        f"CASE WHEN {known} THEN (rank() OVER (PARTITION BY query_id, {known} ORDER BY {score}) - 1"
        f" + count(*) OVER (PARTITION BY query_id, {known}, {score}) / 2.0::DOUBLE)"
        f" / count(*) OVER (PARTITION BY query_id, {known}) END AS p_{score}"
    )


_P3 = f"""
WITH now AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY served_at DESC) AS rn FROM search_hits
    WHERE query_id IS NOT NULL AND file_id IS NOT NULL) WHERE rn = 1),
p AS (SELECT query_id, file_id, {", ".join(_percentile(s) for s in ranking.SCORES)} FROM now),
z AS (SELECT query_id, file_id, {", ".join(f"{ranking.normal_quantile_sql(f'p_{s}')} AS z_{s}" for s in ranking.SCORES)} FROM p),
fused AS (
  SELECT query_id, file_id, {" + ".join(f"(z_{s} IS NOT NULL)::INT" for s in ranking.SCORES)} AS n_known,
    CASE WHEN coalesce({", ".join(f"z_{s}" for s in ranking.SCORES)}) IS NOT NULL
         THEN ({" + ".join(f"coalesce(z_{s}, 0)" for s in ranking.SCORES)}) / {len(ranking.SCORES)} END AS fused FROM z)
"""


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "file_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(p4_neighbours(spark, d)).select("file_a", "file_b")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(p8_ids(spark, d))


def p5_credentials(spark: SparkSession, d: str) -> DataFrame:
    heads = secrets.credentials(table(spark, d, "files"), "files", text="content_head", version="indexed_at_ns")
    return heads.unionByName(secrets.credentials(table(spark, d, "chunks"), "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_credentials(spark, d).select("place", "row_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    heads = secrets.redacted(table(spark, d, "files"), "files", text="content_head")
    return heads.unionByName(secrets.redacted(table(spark, d, "chunks"), "chunks"))


def p6_origins(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.origins(table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_origins(spark, d).filter("origin IS NOT NULL").select("file_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("share", F.round("share", 4))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    found = language.language_segments(table(spark, d, "documents"))
    return found.withColumn("confidence", F.round("confidence", 4))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.unlabelled_languages(documents, language.language_segments(documents))


#: A chunk itself, and what its pieces must say: its lines run to that of its last character.
_REBUILT = """
SELECT id AS chunk_id, content, CASE WHEN start_line > 0 THEN start_line ELSE 0 END AS start_line,
  CASE WHEN start_line > 0 THEN start_line + length(body) - length(replace(body, chr(10), '')) ELSE 0 END AS end_line,
  symbol, 1 AS n_symbols, true AS within_limit, true AS within_overlap
FROM (SELECT DISTINCT id, content, start_line, symbol, substring(content, 1, length(content) - 1) AS body FROM chunks WHERE length(content) > 1200 AND id IS NOT NULL)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_rebuilt": p2_rebuilt,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
    "p5_found": p5_found,
    "p5_credentials": p5_credentials,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_origins": p6_origins,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
}
SQL = {
    "p1_found": _P1 + "SELECT item_a AS concept_a, item_b AS concept_b FROM llr WHERE n_ab::HUGEINT * n >= 8 * n_a::HUGEINT * n_b AND llr >= 3.84",
    "p1_pairs": _P1 + "SELECT item_a, item_b, n_a, n_b, n_ab, n, round(lift, 6) AS lift, round(llr, 4) AS llr FROM llr WHERE lift > 1 AND llr >= 3.84",
    "p2_found": _P2,
    "p2_rebuilt": _REBUILT,
    "p3_found": _P3 + "SELECT query_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC NULLS LAST, file_id) AS rn FROM fused) WHERE rn <= 5",
    "p3_scores": _P3 + "SELECT query_id, file_id, round(fused, 6) + 0.0 AS fused, n_known FROM fused",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
