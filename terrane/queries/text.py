"""Queries on text analysis and windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.functions.vectors import term_hash
from terrane.operators.chunking import window_chunks as windows
from terrane.operators.inverted import term_statistics
from terrane.operators.relational import current_files
from terrane.queries.common import CHUNKS, FILES, bigrams, is_cjk, phrases, quoted, runs, terms, tokens, trimmed
from terrane.tables import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "content").distinct()


def script_runs(spark, d):
    return _chunks(spark, d).select("id", X.script_runs(F.col("content")).alias("runs"))


def analyze_terms(spark, d):
    t = X.analyze_terms(F.col("content"))
    return _chunks(spark, d).select("id", F.size(t).alias("n_terms"), F.size(X.distinct_terms(t)).alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("terms"))


def index_tokens(spark, d):
    found = table(spark, d, "documents").select("doc_id", X.index_tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


def segment_index(spark, d):
    """The search column of chunks, made again from their contents."""
    return _chunks(spark, d).select("id", X.segment_index(F.col("content")).alias("search_text"))


def match_phrases(spark, d):
    hits = table(spark, d, "search_hits").select("query_text").distinct()
    return hits.select("query_text", F.sort_array(X.match_phrases(F.col("query_text"))).alias("phrases"))


def term_frequencies(spark, d):
    rows = _chunks(spark, d).select("id", F.explode(X.analyze_terms(F.col("content"))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(spark, d):
    return term_statistics(table(spark, d, "documents"), "text")


def window_chunks(spark, d):
    return windows(table(spark, d, "documents"), "doc_id", "text")


def chunk_hashes(spark, d):
    return _chunks(spark, d).select("id", X.sha256_hex(F.col("content")).alias("hash"))


def truncate_utf8(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.truncate_utf8(F.col("text"), 64).alias("head"))


def compact_snippets(spark, d):
    files = current_files(table(spark, d, "files"), ["content_head"])
    return files.select("id", X.compact_snippet(F.col("content_head"), 320).alias("snippet"))


def strip_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_markdown(F.col("text")).alias("plain"))


def headings(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.headings(F.col("text"))).alias("pos", "heading"))


def term_hashes(spark, d):
    rows = table(spark, d, "documents").select(F.explode(X.analyze_terms(F.col("text"))).alias("term")).distinct()
    hashed = rows.withColumn("h", term_hash(F.col("term")))
    return hashed.select("term", (F.col("h.hash") % 256).cast("int").alias("slot"), F.col("h.negative").alias("negative"))


FNV = "list_reduce(list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INT, 2))::UTINYINT::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


def _markup(x: str) -> str:
    for pattern, replacement in X.MARKUP:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return x


_BOILER = " OR ".join(f"contains(h, {quoted(p)})" for p in X.BOILERPLATE)
_C = f"WITH {CHUNKS}"

QUERIES = {f.__name__: f for f in (
    script_runs, analyze_terms, index_tokens, segment_index, match_phrases, term_frequencies, document_frequencies, window_chunks, chunk_hashes,
    truncate_utf8, compact_snippets, strip_markdown, headings, term_hashes,
)}
SQL = {
    "script_runs": f"{_C} SELECT id, {runs('content')} AS runs FROM ch",
    "analyze_terms": f"{_C} SELECT id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS terms FROM (SELECT id, {terms('content')} AS t FROM ch)",
    "index_tokens": f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "segment_index": f"{_C} SELECT id, array_to_string(flatten(list_transform(list_filter({runs('content')}, lambda r: {is_cjk('r')}), lambda r: {bigrams('r')})), ' ') AS search_text FROM ch",
    "match_phrases": f"SELECT query_text, list_sort({phrases('query_text')}) AS phrases FROM (SELECT DISTINCT query_text FROM search_hits)",
    "term_frequencies": f"{_C}, t AS (SELECT id, unnest({terms('content')}) AS term FROM ch) SELECT id, term, count(*) AS tf FROM t GROUP BY ALL",
    "document_frequencies": f"WITH t AS (SELECT doc_id, unnest({terms('text')}) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL",
    "window_chunks": f"""WITH w AS (SELECT doc_id AS id, text, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1000.0)::BIGINT) + 1)) AS i FROM documents WHERE text <> ''),
        p AS (SELECT id, i, {trimmed('substr(text, (i * 1000 + 1)::BIGINT, 1200)')} AS content FROM w)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS ordinal, content, sha256(content) AS content_hash FROM p WHERE content <> ''""",
    "chunk_hashes": f"{_C} SELECT id, sha256(content) AS hash FROM ch",
    "truncate_utf8": "SELECT doc_id, substr(text, 1, CAST(list_max(list_filter(range(0, 65), lambda n: octet_length(encode(substr(text, 1, n::INT))) <= 64)) AS INT)) AS head FROM documents WHERE text IS NOT NULL",
    "compact_snippets": f"""WITH {FILES}, t AS (SELECT id, {trimmed("coalesce(content_head, '')")} AS s FROM cur)
        SELECT id, CASE WHEN octet_length(encode(s)) <= 320 THEN s ELSE substr(s, 1, CAST(list_max(list_filter(range(60, 321), lambda n: octet_length(encode(substr(s, 1, n::INT))) <= 320)) AS INT)) || '…' END AS snippet FROM t""",
    "strip_markdown": f"SELECT doc_id, {_markup("coalesce(text, '')")} AS plain FROM documents",
    "headings": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        h AS (SELECT doc_id, i, regexp_replace({trimmed("regexp_extract(line, '^[\\t\\n\\f\\r ]*#{1,3}[\\t\\n\\f\\r ]+([^\\n]+?)[\\t\\n\\f\\r ]*$', 1)")}, '^[0-9.、\\t\\n\\f\\r ()（）:：]+', '') AS h FROM l),
        k AS (SELECT doc_id, {trimmed('h')} AS heading, min(i) AS i FROM h WHERE octet_length(encode(h)) >= 2 AND NOT ({_BOILER}) AND {trimmed('h')} <> '' GROUP BY ALL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, heading FROM k""",
    "term_hashes": f"WITH t AS (SELECT DISTINCT term FROM (SELECT unnest({terms('text')}) AS term FROM documents)), h AS (SELECT term, {FNV.format('term')} AS h FROM t) SELECT term, (h % 256)::INT AS slot, h >= 9223372036854775808::UHUGEINT AS negative FROM h",
}
