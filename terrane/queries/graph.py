"""Queries on concepts and their graph."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.operators import graph, retrieval
from terrane.operators.relational import current_files
from terrane.queries.common import ASKED, CHUNKS, FILES, quoted, runs
from terrane.queries.text import _markup
from terrane.tables import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["id"])


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concept_occurrences")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").filter(F.col("id") % 20 == 0).select("name")


def extract_terms(spark, d):
    words = _chunks(spark, d).select("id", F.explode(X.concept_words(F.col("content"))).alias("word"))
    return words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def extract_concepts(spark, d):
    return graph.extract_concepts(_chunks(spark, d))


def concept_nodes(spark, d):
    return graph.concept_nodes(graph.extract_concepts(_chunks(spark, d)))


def concept_doc_counts(spark, d):
    return graph.doc_counts(_occurrences(spark, d))


def concept_edges(spark, d):
    return graph.edges(_occurrences(spark, d))


def related_concepts(spark, d):
    found = graph.related(_names(spark, d), table(spark, d, "concepts"), graph.edges(_occurrences(spark, d)), graph.doc_counts(_occurrences(spark, d)))
    return found.withColumn("score", F.round("score", 6))


def concept_places(spark, d):
    files = current_files(table(spark, d, "files"), ["path"])
    return graph.concept_occurrences(_names(spark, d), table(spark, d, "concepts"), _occurrences(spark, d), _chunks(spark, d), files)


def concept_recall(spark, d):
    concepts = table(spark, d, "concepts")
    queries = concepts.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("name").alias("query_text"))
    return retrieval.concept_neighbours(queries, concepts, graph.edges(_occurrences(spark, d)), _occurrences(spark, d), _chunks(spark, d), 256)


def concept_recall_around(spark, d):
    """The same from the chunks of the named concepts, without the whole graph."""
    concepts = table(spark, d, "concepts")
    queries = concepts.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("name").alias("query_text"))
    return retrieval.concept_neighbours(queries, concepts, None, _occurrences(spark, d), _chunks(spark, d), 256)


def edges_without_chunks(spark, d):
    """The graph after a part of the chunks is gone, as incremental maintenance leaves it."""
    gone = table(spark, d, "chunks").filter(F.col("id") % 2 == 0).select("id")
    return graph.edges(graph.without_chunks(_occurrences(spark, d), gone))


_STOP = ", ".join(map(quoted, X.CONCEPT_STOPWORDS))
_BOIL = " OR ".join(f"contains(w, {quoted(p)})" for p in X.BOILERPLATE)


def words(x: str) -> str:
    return f"list_filter({runs(_markup(f'coalesce({x}, {quoted("")})'))}, lambda w: octet_length(encode(w)) >= 2 AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AND w NOT IN ({_STOP}) AND NOT ({_BOIL}))"


_HEAD = """l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM ch WHERE content IS NOT NULL),
    h0 AS (SELECT id, i, regexp_replace(trim(regexp_extract(line, '^[\\t\\n\\f\\r ]*#{1,3}[\\t\\n\\f\\r ]+([^\\n]+?)[\\t\\n\\f\\r ]*$', 1)), '^[0-9.、\\t\\n\\f\\r ()（）:：]+', '') AS h FROM l),
    heads AS (SELECT id, trim(h) AS name, min(i) AS i FROM h0 WHERE octet_length(encode(h)) >= 2 AND NOT (""" + _BOIL.replace("contains(w", "contains(h") + """) AND trim(h) <> '' GROUP BY ALL)"""
_EXTRACT = f"""WITH {CHUNKS}, {_HEAD}, w AS (SELECT id, unnest({words('content')}) AS name FROM ch WHERE content IS NOT NULL),
    wn AS (SELECT id, name, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2),
    wr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, name) AS r FROM wn),
    both_ AS (SELECT id, name, 'heading' AS kind, i AS o FROM heads UNION ALL SELECT id, name, 'term', r + 1000000 FROM wr WHERE r <= 10),
    f AS (SELECT id, name, arg_min(kind, o) AS kind, min(o) AS o FROM both_ GROUP BY ALL),
    ex AS (SELECT id AS chunk_id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS pos, name, kind FROM f)"""
def named(source: str, text: str) -> str:
    """Common tables ``cst`` (query_id, src): the concepts whose names stand in a text of ``source`` (query_id)."""
    return f"""cql AS (SELECT query_id, {words(text)} AS w FROM {source}),
    cqw AS (SELECT DISTINCT query_id, array_to_string(list_slice(w, i, j), ' ') AS name FROM cql, unnest(range(1, len(w) + 1)) AS a(i), unnest(range(1, len(w) + 1)) AS b(j) WHERE i <= j),
    cnm AS (SELECT id, array_to_string({words('name')}, ' ') AS name FROM concepts),
    cst AS (SELECT DISTINCT query_id, cnm.id AS src FROM cqw JOIN cnm ON cnm.name = cqw.name WHERE cnm.name <> '')"""


_OCC = "occ AS (SELECT DISTINCT concept_id, chunk_id FROM concept_occurrences WHERE concept_id IS NOT NULL AND chunk_id IS NOT NULL)"
_EDGE = "edge AS (SELECT a.concept_id AS src, b.concept_id AS dst, count(*) AS co_count FROM occ a JOIN occ b ON a.chunk_id = b.chunk_id AND a.concept_id < b.concept_id GROUP BY ALL)"
_BOTH = "two AS (SELECT src, dst, co_count FROM edge UNION ALL SELECT dst, src, co_count FROM edge)"

_RECALL = f"""WITH {_OCC}, {_EDGE}, {_BOTH}, {CHUNKS}, asked AS (SELECT id AS query_id, name AS text FROM concepts WHERE id % 20 = 0), {named('asked', 'text')},
        n AS (SELECT DISTINCT query_id, t.dst AS concept_id FROM cst JOIN two t USING (src)),
        w AS (SELECT DISTINCT occ.concept_id, ch.file_id AS id FROM occ JOIN ch ON ch.id = occ.chunk_id),
        st AS (SELECT query_id, id, count(*) AS strength FROM n JOIN w USING (concept_id) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, id) AS rank FROM st) SELECT query_id, id, rank, strength FROM r WHERE rank <= 256"""

QUERIES = {f.__name__: f for f in (
    extract_terms, extract_concepts, concept_nodes, concept_doc_counts, concept_edges, related_concepts, concept_places, concept_recall, concept_recall_around, edges_without_chunks,
)}
SQL = {
    "extract_terms": f"WITH {CHUNKS}, w AS (SELECT id, unnest({words('content')}) AS word FROM ch) SELECT id, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2",
    "extract_concepts": f"{_EXTRACT} SELECT * FROM ex",
    "concept_nodes": f"{_EXTRACT}, o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chunk_id, pos) AS rn FROM ex) SELECT name, max(CASE WHEN rn = 1 THEN kind END) AS kind, count(DISTINCT chunk_id) AS doc_count FROM o GROUP BY name",
    "concept_doc_counts": f"WITH {_OCC} SELECT concept_id AS id, count(*) AS doc_count FROM occ GROUP BY ALL",
    "concept_edges": f"WITH {_OCC}, {_EDGE} SELECT * FROM edge",
    "related_concepts": f"""WITH {_OCC}, {_EDGE}, {_BOTH}, cnt AS (SELECT concept_id AS id, count(*) AS doc_count FROM occ GROUP BY ALL),
        r AS (SELECT a.name, b.name AS related, t.co_count, t.co_count * (ln(t.co_count) - ln(cnt.doc_count)) AS score
          FROM (SELECT name, id FROM concepts WHERE name IN (SELECT name FROM concepts WHERE id % 20 = 0)) a JOIN two t ON t.src = a.id JOIN concepts b ON b.id = t.dst JOIN cnt ON cnt.id = t.dst),
        p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, co_count DESC, related) AS place FROM r)
        SELECT name, related, co_count, round(score, 6) AS score, place FROM p WHERE place <= 20""",
    "concept_places": f"""WITH {_OCC}, {FILES}, {CHUNKS}, r AS (SELECT a.name, f.path, c.symbol, c.start_line, c.end_line, row_number() OVER (PARTITION BY a.name ORDER BY f.path, c.start_line, c.id) AS place
        FROM (SELECT name, id FROM concepts WHERE name IN (SELECT name FROM concepts WHERE id % 20 = 0)) a JOIN occ ON occ.concept_id = a.id JOIN ch c ON c.id = occ.chunk_id JOIN cur f ON f.id = c.file_id) SELECT * FROM r WHERE place <= 20""",
    "concept_recall": _RECALL,
    "concept_recall_around": _RECALL,
    "edges_without_chunks": f"WITH occ AS (SELECT DISTINCT concept_id, chunk_id FROM concept_occurrences WHERE concept_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks WHERE id % 2 = 0)), {_EDGE} SELECT * FROM edge",
}
