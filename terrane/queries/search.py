"""Queries on retrieval: every twentieth query that was served, against all rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.durable import checkpointed, written
from terrane.functions.vectors import bucket, hash_vectors, probes
from terrane.operators import context, inverted, nearest, retrieval
from terrane.operators.relational import current_files
from terrane.queries.common import ASKED, CHUNKS, FILES, phrases, terms, tokens, trimmed, truncated
from terrane.queries.graph import named
from terrane.queries.text import FNV
from terrane.tables import latest, table

#: The clock of the queries, so that ages can be compared.
NOW_NS = 1_760_000_000_000_000_000
_DIMENSIONS = 64
_REQUEST = retrieval.Request(limit=20)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").filter(F.col("query_id") % 20 == 0)
    return hits.groupBy("query_id").agg(F.max("query_text").alias("query_text"))


#: Tables and indexes of this process, by application, table and state of its files.
_STORED: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, name: str, what: str, make):
    """What is stored of a table of a folder; made at first use and again if the table's files change."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path))
    key = (spark.sparkContext.applicationId, d, name, what, state)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The current state of the files, as an index keeps it."""
    columns = ["size", "mtime_ns", "name", "path", "kind", "mime", "tags_text", "content_head", "search_text"]
    return _once(spark, d, "files", "rows", lambda: written(current_files(table(spark, d, "files"), columns), "files"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "chunks", "rows", lambda: written(table(spark, d, "chunks").dropDuplicates(["id"]), "chunks"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_embeddings")
    model = rows.filter(F.col("dimensions") == _DIMENSIONS).groupBy("model").count().orderBy(F.desc("count"), "model").first()
    own = latest(rows.filter(F.col("model") == (model["model"] if model else "")), ["file_id"], "updated_at_ns", ["vector"])
    return own.filter(F.size("vector") == _DIMENSIONS).select(F.col("file_id").alias("id"), "vector")


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return hash_vectors(_asked(spark, d), "query_id", "query_text", _DIMENSIONS).withColumnRenamed("id", "query_id")


def _index(spark: SparkSession, d: str, name: str) -> inverted.Index:
    """The stored index of the files or chunks of a folder."""
    rows, fields = (_files, inverted.FILE_FIELDS) if name == "files" else (_chunks, inverted.CHUNK_FIELDS)
    return _once(spark, d, name, "index", lambda: inverted.Index.of(rows(spark, d), fields).stored(name))


def find(spark, d):
    hits = inverted.find(_index(spark, d, "files"), _asked(spark, d))
    return hits.withColumn("score", F.round("score", 6))


def recall(spark, d):
    return inverted.recalled(_index(spark, d, "files").postings, inverted.query_phrases(_asked(spark, d)), _REQUEST.candidates)


def file_words(spark, d):
    return retrieval.file_words(_files(spark, d), _asked(spark, d), _REQUEST.candidates, _index(spark, d, "files").postings)


def chunk_words(spark, d):
    found = retrieval.chunk_words(_chunks(spark, d), _files(spark, d), _asked(spark, d), _REQUEST.candidates, _index(spark, d, "chunks").postings)
    return found.select("query_id", "id", "rank", "chunk_symbol", "start_line", "end_line")


def query_vectors(spark, d):
    return _query_vectors(spark, d).select("query_id", F.posexplode("vector").alias("slot", "x")).filter("x <> 0").withColumn("x", F.round("x", 5))


def cosine_topk(spark, d):
    found = nearest.exact_topk(_vectors(spark, d), _query_vectors(spark, d), 50)
    return found.withColumn("cosine", F.round("cosine", 6))


def _every_vector(spark: SparkSession, d: str) -> DataFrame:
    """The current vectors of all models that have as many numbers as they say."""
    rows = table(spark, d, "file_embeddings").filter("file_id IS NOT NULL AND model IS NOT NULL")
    own = latest(rows, ["file_id", "model"], "updated_at_ns", ["dimensions", "vector"])
    return own.filter((F.size("vector") == F.col("dimensions")) & (F.size("vector") >= 8)).select(F.col("file_id").alias("id"), "model", "vector")


def sign_buckets(spark, d):
    return _every_vector(spark, d).select("id", "model", bucket(F.col("vector")).alias("bucket"))


def bucket_probes(spark, d):
    return _every_vector(spark, d).select("id", "model", F.posexplode(probes(F.col("vector"))).alias("place", "bucket"))


def probed_topk(spark, d):
    found = nearest.probed_topk(_vectors(spark, d), _query_vectors(spark, d), 50, limit=1000)
    return found.withColumn("cosine", F.round("cosine", 6))


def metadata_only_search(spark, d):
    request = retrieval.Request(limit=20, kinds=("file",), path_prefix="/srv/trees/", min_size=200, max_size=5000)
    empty = spark.range(1, 4).select(F.col("id").alias("query_id"), F.lit("").alias("query_text"))
    files = _files(spark, d)
    hits = retrieval.placed(retrieval.fuse(empty, files, request, NOW_NS, metadata=retrieval.newest(files, empty, request)), request.bounded)
    return hits.select("query_id", "place", "id", "path", F.round("score", 6).alias("score"))


def _hybrid(spark, d):
    files, asked = _files(spark, d), _asked(spark, d)
    vectors = nearest.exact_topk(_vectors(spark, d), _query_vectors(spark, d), 4 * _REQUEST.candidates)
    return retrieval.hybrid_search(asked, files, _chunks(spark, d), _REQUEST, NOW_NS, vectors=vectors, **_indexes(spark, d))


def _indexes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"file_index": _index(spark, d, "files").postings, "chunk_index": _index(spark, d, "chunks").postings}


def _near_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks, by the same hashing as those of the queries."""
    texts = _chunks(spark, d).select("id", F.concat_ws("\n", F.coalesce("symbol", F.lit("")), F.coalesce("content", F.lit(""))).alias("text"))
    vectors = hash_vectors(texts, "id", "text", _DIMENSIONS)
    found = nearest.exact_topk(vectors, _query_vectors(spark, d), 4 * _REQUEST.candidates)
    return retrieval.chunk_vectors(found, _chunks(spark, d))


def near_chunks(spark, d):
    """The nearest chunk of each file, with its place."""
    return _near_chunks(spark, d).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "chunk_symbol", "start_line", "end_line")


def hybrid_chunk_vectors(spark, d):
    """Files by the vectors of files and of chunks: a nearer chunk gives its cosine, and its place where no words rank."""
    files, asked = _files(spark, d), _asked(spark, d)
    vectors = nearest.exact_topk(_vectors(spark, d), _query_vectors(spark, d), 4 * _REQUEST.candidates)
    hits = retrieval.hybrid_search(asked, files, _chunks(spark, d), _REQUEST, NOW_NS, vectors=vectors, near_chunks=_near_chunks(spark, d), **_indexes(spark, d))
    return hits.select("query_id", "place", "id", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), "chunk_symbol", "start_line", "end_line")


def hybrid_search(spark, d):
    return _hybrid(spark, d).select("query_id", "place", "id", "path", F.round("score", 6).alias("score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("vector_score", 6).alias("vector_score"), "chunk_symbol", "start_line")


def hybrid_concept_fusion(spark, d):
    """With the concept arm: neighbours of the concepts whose whole names stand in the query."""
    files, chunks, asked = _files(spark, d), _chunks(spark, d), _asked(spark, d)
    concepts = table(spark, d, "concepts")
    occurrences = table(spark, d, "concept_occurrences")
    near = retrieval.concept_neighbours(asked, concepts, None, occurrences, chunks, _REQUEST.candidates)
    vectors = nearest.exact_topk(_vectors(spark, d), _query_vectors(spark, d), 4 * _REQUEST.candidates)
    hits = retrieval.hybrid_search(asked, files, chunks, _REQUEST, NOW_NS, vectors=vectors, concepts=near, **_indexes(spark, d))
    return hits.select("query_id", "place", "id", "path", F.round("score", 6).alias("score"), "concept_rank")


def _stub(query: str, documents: list[str]) -> list[float]:
    """Stands for a cross-encoder: the shorter the document, the better."""
    return [-float(len(x.encode())) / 1000 for x in documents]


def rerank_window(spark, d):
    files, asked = _files(spark, d), _asked(spark, d)
    hits = retrieval.placed(retrieval.fuse(asked, files, _REQUEST, NOW_NS, words=retrieval.file_words(files, asked, _REQUEST.candidates, _index(spark, d, "files").postings)))
    out = retrieval.rerank(hits, asked, 10, _stub)
    return out.select("query_id", "place", "id", F.round("score", 6).alias("score"))


def context_contents(spark, d):
    hits = checkpointed(_hybrid(spark, d))  # read twice
    return context.hit_contents(hits, _chunks(spark, d), _files(spark, d))


def context_pack(spark, d):
    hits = checkpointed(_hybrid(spark, d))  # read twice
    pack = context.context_pack(hits, context.hit_contents(hits, _chunks(spark, d), _files(spark, d)), budget=1000)
    return pack.select("query_id", "place", "path", "chunk_symbol", "content", "estimated_tokens", "truncated")


def _posted(name: str, rows: str, fields: tuple[str, ...]) -> str:
    each = " UNION ALL ".join(f"SELECT id, {n} AS field, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT id, {tokens(f)} AS t FROM {rows})" for n, f in enumerate(fields))
    return f"""{name}_post AS ({each}),
    {name}_hits AS (
      SELECT query_id, phrase, id, field, pos AS at FROM qt JOIN {name}_post USING (token) WHERE n = 1
      UNION ALL SELECT query_id, phrase, id, field, pos - off FROM qt JOIN {name}_post USING (token) WHERE n > 1 GROUP BY query_id, phrase, id, field, pos - off, n HAVING count(DISTINCT off) = n),
    {name}_rec AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rn FROM (SELECT DISTINCT query_id, id FROM {name}_hits)) WHERE rn <= {_REQUEST.candidates})"""


_QT = f"""qp AS (SELECT query_id, unnest({phrases('query_text')}) AS phrase FROM q),
    qt AS (SELECT query_id, phrase, len({tokens('phrase')}) AS n, unnest({tokens('phrase')}) AS token, generate_subscripts({tokens('phrase')}, 1) - 1 AS off FROM qp)"""


def _weight(tf: str, length: str, average: str, n: str, df: str) -> str:
    return f"ln(1 + ({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / greatest(1, {average})))"


def _local(name: str, rows: str, text: str) -> str:
    return f"""{name}_t AS (SELECT id, {terms(text)} AS t FROM {rows} WHERE id IN (SELECT id FROM {name}_rec)),
    {name}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
    {name}_corpus AS (SELECT query_id, count(*) AS n, avg(len(t)) AS average FROM {name}_rec JOIN {name}_t USING (id) GROUP BY query_id),
    {name}_h AS (SELECT query_id, id, term, tf FROM {name}_rec JOIN qw USING (query_id) JOIN {name}_tf USING (id, term)),
    {name}_df AS (SELECT query_id, term, count(*) AS df FROM {name}_h GROUP BY ALL),
    {name}_sum AS (SELECT query_id, id, sum({_weight('tf', 'len(t)', 'average', 'n', 'df')}) AS score
      FROM {name}_h JOIN {name}_df USING (query_id, term) JOIN {name}_corpus USING (query_id) JOIN {name}_t USING (id) GROUP BY ALL),
    {name}_scored AS (SELECT query_id, id, round(coalesce(score, 0), 9) AS score FROM {name}_rec LEFT JOIN {name}_sum USING (query_id, id))"""


_QW = f"qw AS (SELECT DISTINCT query_id, unnest({terms('query_text')}) AS term FROM q)"
_FILE_ARM = f"""{_posted('fl', 'cur', inverted.FILE_FIELDS)}, {_local('fl', 'cur', "name || ' ' || path || ' ' || coalesce(tags_text, '') || ' ' || coalesce(content_head, '')")},
    s0 AS (SELECT id, {trimmed("coalesce(content_head, '')")} AS s FROM cur),
    fw AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, id) AS rank,
      CASE WHEN octet_length(encode(s)) <= 320 THEN s ELSE {truncated('s', 320)} || '…' END AS snippet FROM fl_scored JOIN cur USING (id) JOIN s0 USING (id))"""
_CHUNK_ARM = f"""{_posted('ck', 'ch', inverted.CHUNK_FIELDS)}, {_local('ck', 'ch', "coalesce(symbol, '') || ' ' || coalesce(content, '')")},
    cr AS (SELECT query_id, c.file_id AS id, coalesce(c.symbol, '') AS chunk_symbol, c.start_line, c.end_line, c.content,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, c.id) AS rank FROM ck_scored s JOIN ch c ON c.id = s.id JOIN cur f ON f.id = c.file_id),
    cw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank) AS rn FROM cr) WHERE rn = 1)"""
_VECTOR = f"""vm AS (SELECT model FROM file_embeddings WHERE dimensions = {_DIMENSIONS} GROUP BY model ORDER BY count(*) DESC, model LIMIT 1),
    v AS (SELECT file_id AS id, vector FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY updated_at_ns DESC, vector DESC) AS rn FROM file_embeddings WHERE model = (SELECT model FROM vm)) WHERE rn = 1 AND len(vector) = {_DIMENSIONS})"""
_EVERY = """v AS (SELECT file_id AS id, model, vector FROM (SELECT *, row_number() OVER (PARTITION BY file_id, model ORDER BY updated_at_ns DESC, dimensions DESC, vector DESC) AS rn FROM file_embeddings WHERE file_id IS NOT NULL AND model IS NOT NULL)
      WHERE rn = 1 AND len(vector) = dimensions AND len(vector) >= 8)"""
_QV = f"""qc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({terms('query_text')}) AS term FROM q) GROUP BY ALL),
    qh AS (SELECT query_id, tf, {FNV.format('term')} AS h FROM qc),
    qs AS (SELECT query_id, (h % {_DIMENSIONS})::INT AS slot, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -tf ELSE tf END)::DOUBLE AS x FROM qh GROUP BY ALL),
    qn AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM qs GROUP BY query_id),
    qx AS (SELECT query_id, slot, CASE WHEN norm > 0 THEN (x / norm)::FLOAT ELSE x::FLOAT END AS x FROM qs JOIN qn USING (query_id))"""
_COS = """vx AS (SELECT id, generate_subscripts(vector, 1) - 1 AS slot, unnest(vector)::DOUBLE AS y FROM v),
    vn AS (SELECT id, sqrt(sum(y * y)) AS norm FROM vx GROUP BY id HAVING isfinite(sqrt(sum(y * y))) AND sqrt(sum(y * y)) > 0),
    qq AS (SELECT query_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM qx GROUP BY query_id),
    cs AS (SELECT query_id, id, sum(x::DOUBLE * y) / max(qq.norm) / max(vn.norm) AS cosine FROM qx JOIN vx USING (slot) JOIN vn USING (id) JOIN qq USING (query_id) WHERE qq.norm > 0 GROUP BY query_id, id),
    ck2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rn FROM cs WHERE round(cosine, 9) > 0)"""


def _rr(rank: str) -> str:
    return f"CASE WHEN {rank} > 0 THEN 61.0::DOUBLE / (60 + {rank}) ELSE 0 END"


_AGE = f"1 / (1 + greatest(0, ({NOW_NS} - mtime_ns) / 86400000000000.0::DOUBLE) / 365)"
_FUSED = f"""meta AS (SELECT query_id, id FROM q CROSS JOIN (SELECT id FROM cur ORDER BY mtime_ns DESC, id LIMIT {_REQUEST.candidates})),
    va AS (SELECT query_id, id, cosine FROM ck2 WHERE rn <= {4 * _REQUEST.candidates}),
    ids AS (SELECT query_id, id FROM fw UNION SELECT query_id, id FROM cw UNION SELECT query_id, id FROM va UNION SELECT query_id, id FROM meta),
    m AS (SELECT i.query_id, f.*, CASE WHEN cw.rank IS NOT NULL AND (fw.rank IS NULL OR cw.rank <= fw.rank) THEN cw.rank ELSE coalesce(fw.rank, 0) END AS lex,
        cw.rank IS NOT NULL AND (fw.rank IS NULL OR cw.rank <= fw.rank) AS wins, cw.chunk_symbol AS cs, cw.start_line AS sl, cw.content AS cc, fw.snippet AS fs, greatest(0, coalesce(va.cosine, 0)) AS vs
      FROM ids i JOIN cur f USING (id) LEFT JOIN fw USING (query_id, id) LEFT JOIN cw USING (query_id, id) LEFT JOIN va USING (query_id, id)),
    mm AS (SELECT *, CASE WHEN vs > 0 THEN row_number() OVER (PARTITION BY query_id, vs > 0 ORDER BY round(vs, 9) DESC, path, id) ELSE 0 END AS vr FROM m WHERE lex > 0 OR vs > 0),
    sc AS (SELECT *, 0.52::DOUBLE * {_rr('lex')} + 0.38::DOUBLE * {_rr('vr')} + 0.10::DOUBLE * {_AGE} AS score FROM mm),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, id) AS place FROM sc)"""
_HYBRID = f"WITH {ASKED}, {FILES}, {CHUNKS}, {_QT}, {_QW}, {_FILE_ARM}, {_CHUNK_ARM}, {_VECTOR}, {_QV}, {_COS}, {_FUSED}"
_CONCEPT_ARM = f"""occ AS (SELECT DISTINCT concept_id, chunk_id FROM concept_occurrences WHERE concept_id IS NOT NULL AND chunk_id IS NOT NULL),
    {named('q', 'query_text')},
    cnb AS (SELECT DISTINCT query_id, b.concept_id FROM cst JOIN occ a ON a.concept_id = cst.src JOIN occ b ON b.chunk_id = a.chunk_id AND b.concept_id <> a.concept_id),
    cwh AS (SELECT DISTINCT occ.concept_id, ch.file_id AS id FROM occ JOIN ch ON ch.id = occ.chunk_id),
    csg AS (SELECT query_id, id, count(*) AS strength FROM cnb JOIN cwh USING (concept_id) GROUP BY ALL),
    cn AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, id) AS cr FROM csg) WHERE cr <= {_REQUEST.candidates})"""
_FUSED_CONCEPTS = (
    _FUSED.replace("UNION SELECT query_id, id FROM meta)", "UNION SELECT query_id, id FROM cn UNION SELECT query_id, id FROM meta)")
    .replace("greatest(0, coalesce(va.cosine, 0)) AS vs", "greatest(0, coalesce(va.cosine, 0)) AS vs, coalesce(cn.cr, 0) AS cr")
    .replace("LEFT JOIN va USING (query_id, id))", "LEFT JOIN va USING (query_id, id) LEFT JOIN cn USING (query_id, id))")
    .replace("WHERE lex > 0 OR vs > 0)", "WHERE lex > 0 OR vs > 0 OR cr > 0)")
    .replace(f"0.52::DOUBLE * {_rr('lex')} + 0.38::DOUBLE * {_rr('vr')} + 0.10::DOUBLE * {_AGE}", f"0.47::DOUBLE * {_rr('lex')} + 0.34::DOUBLE * {_rr('vr')} + 0.09::DOUBLE * {_AGE} + 0.10::DOUBLE * {_rr('cr')}")
)
_NEAR = f"""hc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms("coalesce(symbol, '') || chr(10) || coalesce(content, '')")}) AS term FROM ch) GROUP BY ALL),
    hh AS (SELECT id, tf, {FNV.format('term')} AS h FROM hc),
    hs AS (SELECT id, (h % {_DIMENSIONS})::INT AS slot, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -tf ELSE tf END)::DOUBLE AS y FROM hh GROUP BY ALL),
    hn AS (SELECT id, sqrt(sum(y * y)) AS norm FROM hs GROUP BY id HAVING sqrt(sum(y * y)) > 0),
    hx AS (SELECT id, slot, (y / norm)::FLOAT::DOUBLE AS y FROM hs JOIN hn USING (id)),
    hl AS (SELECT id, sqrt(sum(y * y)) AS norm FROM hx GROUP BY id),
    hq AS (SELECT query_id, id, sum(x::DOUBLE * y) / max(qq.norm) / max(hl.norm) AS cosine FROM qx JOIN hx USING (slot) JOIN hl USING (id) JOIN qq USING (query_id) WHERE qq.norm > 0 GROUP BY query_id, id),
    hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rn FROM hq WHERE round(cosine, 9) > 0),
    hb AS (SELECT r.query_id, c.file_id, r.cosine, coalesce(c.symbol, '') AS chunk_symbol, c.start_line, c.end_line,
      row_number() OVER (PARTITION BY r.query_id, c.file_id ORDER BY round(r.cosine, 9) DESC, r.id) AS best FROM hr r JOIN ch c ON c.id = r.id WHERE rn <= {4 * _REQUEST.candidates}),
    nc AS (SELECT query_id, file_id AS id, cosine, chunk_symbol, start_line, end_line FROM hb WHERE best = 1)"""
_FUSED_NEAR = (
    _FUSED.replace("UNION SELECT query_id, id FROM meta)", "UNION SELECT query_id, id FROM nc UNION SELECT query_id, id FROM meta)")
    .replace("greatest(0, coalesce(va.cosine, 0)) AS vs", "greatest(0, coalesce(va.cosine, 0), coalesce(nc.cosine, 0)) AS vs, cw.end_line AS el, nc.chunk_symbol AS ns, nc.start_line AS nl, nc.end_line AS ne, nc.cosine IS NOT NULL AND (va.cosine IS NULL OR round(nc.cosine, 9) > round(va.cosine, 9)) AS nw")
    .replace("LEFT JOIN va USING (query_id, id))", "LEFT JOIN va USING (query_id, id) LEFT JOIN nc USING (query_id, id))")
)
_CONTENTS = f"""{_HYBRID}, top AS (SELECT query_id, place, id, path, kind, content_head, CASE WHEN wins THEN cs ELSE '' END AS chunk_symbol, CASE WHEN wins THEN sl ELSE 0 END AS at, CASE WHEN wins THEN cc ELSE coalesce(fs, '') END AS snippet FROM hits WHERE place <= 20),
    near AS (SELECT t.query_id, t.id, c.ordinal, c.id AS chunk_id, CASE WHEN coalesce(c.symbol, '') <> '' THEN '// ' || c.symbol || ' lines ' || c.start_line || '-' || c.end_line || chr(10) ELSE '' END || coalesce(c.content, '') AS body,
        row_number() OVER (PARTITION BY t.query_id, t.id ORDER BY CASE WHEN coalesce(c.symbol, '') = t.chunk_symbol AND t.chunk_symbol <> '' THEN 0 ELSE 1 END, abs(c.start_line - t.at), c.ordinal, c.id) AS rn FROM top t JOIN ch c ON c.file_id = t.id),
    joined AS (SELECT query_id, id, string_agg(body, chr(10) || chr(10) ORDER BY ordinal, chunk_id) AS content FROM near WHERE rn <= 6 GROUP BY ALL),
    contents AS (SELECT t.query_id, t.id, coalesce(nullif(j.content, ''), nullif(t.snippet, ''), coalesce(t.content_head, '')) AS content FROM top t LEFT JOIN joined j USING (query_id, id))"""
_PACK = f"""{_CONTENTS}, it AS (SELECT t.*, {trimmed('c.content')} AS content, octet_length(encode(path)) + 1 AS head FROM top t JOIN contents c USING (query_id, id)),
    run AS (SELECT *, coalesce(sum(head + octet_length(encode(content))) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM it),
    room AS (SELECT *, 4000 - before - head AS room FROM run),
    cut AS (SELECT *, room > 0 AS kept, CASE WHEN octet_length(encode(content)) <= room THEN content WHEN room > 0 THEN
        substr(content, 1, CAST(list_max(list_filter(range(0, least(length(content), room)::BIGINT + 1), lambda n: octet_length(encode(substr(content, 1, n::INT))) <= room)) AS INT)) END AS body FROM room),
    pk AS (SELECT *, floor((least(4000, sum(CASE WHEN kept THEN head + octet_length(encode(body)) ELSE 0 END) OVER (PARTITION BY query_id)) + 3) / 4)::BIGINT AS estimated_tokens,
        bool_or((kept AND octet_length(encode(content)) > room) OR (NOT kept AND before < 4000)) OVER (PARTITION BY query_id) AS truncated FROM cut)"""
_W = f"WITH {ASKED}, {FILES}, {CHUNKS}, {_QT}, {_QW}"

QUERIES = {f.__name__: f for f in (
    find, recall, file_words, chunk_words, query_vectors, cosine_topk, sign_buckets, bucket_probes, probed_topk, metadata_only_search, hybrid_search, hybrid_concept_fusion, near_chunks, hybrid_chunk_vectors, rerank_window, context_contents, context_pack,
)}
_BITS = "list_sum(list_transform(range(0, 8), lambda i: CASE WHEN vector[(i + 1)::INT] >= 0 THEN (1 << i::INT) ELSE 0 END))::INT"
SQL = {
    "find": f"""{_W}, {_posted('fl', 'cur', inverted.FILE_FIELDS)}, len_ AS (SELECT id, {' + '.join(f'len({tokens(f)})' for f in inverted.FILE_FIELDS)} AS length FROM cur),
        tot AS (SELECT count(*) AS n, avg(length) AS average FROM len_), tf AS (SELECT query_id, phrase, id, count(*) AS tf FROM fl_hits GROUP BY ALL), df AS (SELECT query_id, phrase, count(*) AS df FROM tf GROUP BY ALL)
        SELECT query_id, id, round(sum({_weight('tf', 'length', 'average', 'n', 'df')}), 6) AS score FROM tf JOIN df USING (query_id, phrase) JOIN len_ USING (id) CROSS JOIN tot GROUP BY ALL""",
    "recall": f"{_W}, {_posted('fl', 'cur', inverted.FILE_FIELDS)} SELECT * FROM fl_rec",
    "file_words": f"{_W}, {_FILE_ARM} SELECT * FROM fw",
    "chunk_words": f"{_W}, {_CHUNK_ARM} SELECT query_id, id, rank, chunk_symbol, start_line, end_line FROM cw",
    "query_vectors": f"WITH {ASKED}, {_QV} SELECT query_id, slot, round(x, 5) AS x FROM qx WHERE x <> 0",
    "cosine_topk": f"WITH {ASKED}, {_VECTOR}, {_QV}, {_COS} SELECT query_id, id, round(cosine, 6) AS cosine FROM ck2 WHERE rn <= 50",
    "sign_buckets": f"WITH {_EVERY} SELECT id, model, {_BITS} AS bucket FROM v",
    "bucket_probes": f"""WITH {_EVERY}, b AS (SELECT id, model, vector, {_BITS} AS own FROM v), p AS (SELECT id, model, own, unnest(range(0, 8)) AS bit, vector FROM b),
        o AS (SELECT id, model, xor(own, (1 << bit::INT)::INT) AS bucket, row_number() OVER (PARTITION BY id, model ORDER BY abs(vector[(bit + 1)::INT]), bit) AS place FROM p)
        SELECT id, model, 0 AS place, own AS bucket FROM b UNION ALL SELECT id, model, place, bucket FROM o""",
    "probed_topk": f"""WITH {ASKED}, {_VECTOR}, {_QV}, {_COS}, qb AS (SELECT query_id, sum(CASE WHEN coalesce(x, 0) >= 0 THEN (1 << slot::INT) ELSE 0 END)::INT AS own
          FROM (SELECT q.query_id, s.slot, qx.x FROM q CROSS JOIN (SELECT unnest(range(0, 8)) AS slot) s LEFT JOIN qx ON qx.query_id = q.query_id AND qx.slot = s.slot) GROUP BY query_id),
        pb AS (SELECT query_id, own AS bucket FROM qb UNION SELECT query_id, xor(own, (1 << b::INT)::INT) FROM qb, (SELECT unnest(range(0, 8)) AS b)),
        cand AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rn FROM pb JOIN (SELECT id, {_BITS} AS bucket FROM v) USING (bucket)),
        got AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rn FROM cand c JOIN cs USING (query_id, id) WHERE c.rn <= 9000 AND round(cosine, 9) > 0)
        SELECT query_id, id, round(cosine, 6) AS cosine FROM got WHERE rn <= 50""",
    "metadata_only_search": f"""WITH {FILES}, c AS (SELECT id, path, mtime_ns FROM cur WHERE kind = 'file' AND size BETWEEN 200 AND 5000 AND starts_with(path, '/srv/trees/') ORDER BY mtime_ns DESC, id LIMIT 256),
        s AS (SELECT *, 0.1::DOUBLE * {_AGE} AS score FROM c), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, path, id) AS place FROM s)
        SELECT query_id, place, id, path, round(score, 6) AS score FROM r, (SELECT unnest([1, 2, 3])::BIGINT AS query_id) WHERE place <= 20""",
    "hybrid_search": f"{_HYBRID} SELECT query_id, place, id, path, round(score, 6) AS score, round({_rr('lex')}, 6) AS bm25_score, round(vs, 6) AS vector_score, CASE WHEN wins THEN cs ELSE '' END AS chunk_symbol, CASE WHEN wins THEN sl ELSE 0 END AS start_line FROM hits WHERE place <= 20",
    "hybrid_concept_fusion": f"WITH {ASKED}, {FILES}, {CHUNKS}, {_QT}, {_QW}, {_FILE_ARM}, {_CHUNK_ARM}, {_VECTOR}, {_QV}, {_COS}, {_CONCEPT_ARM}, {_FUSED_CONCEPTS} SELECT query_id, place, id, path, round(score, 6) AS score, cr AS concept_rank FROM hits WHERE place <= 20",
    "near_chunks": f"WITH {ASKED}, {FILES}, {CHUNKS}, {_QV}, qq AS (SELECT query_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM qx GROUP BY query_id), {_NEAR} SELECT query_id, id, round(cosine, 6) AS cosine, chunk_symbol, start_line, end_line FROM nc",
    "hybrid_chunk_vectors": f"WITH {ASKED}, {FILES}, {CHUNKS}, {_QT}, {_QW}, {_FILE_ARM}, {_CHUNK_ARM}, {_VECTOR}, {_QV}, {_COS}, {_NEAR}, {_FUSED_NEAR} SELECT query_id, place, id, round(score, 6) AS score, round(vs, 6) AS vector_score, CASE WHEN wins THEN cs WHEN nw AND lex = 0 THEN ns ELSE '' END AS chunk_symbol, CASE WHEN wins THEN sl WHEN nw AND lex = 0 THEN nl ELSE 0 END AS start_line, CASE WHEN wins THEN el WHEN nw AND lex = 0 THEN ne ELSE 0 END AS end_line FROM hits WHERE place <= 20",
    "rerank_window": f"""{_W}, {_FILE_ARM}, s AS (SELECT query_id, id, path, snippet, 0.52::DOUBLE * {_rr('rank')} + 0.10::DOUBLE * {_AGE} AS score FROM fw JOIN cur USING (id)),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, id) AS place0 FROM s),
        d AS (SELECT *, -octet_length(encode(CASE WHEN snippet <> '' THEN snippet ELSE path END)) / 1000.0::DOUBLE AS logit FROM p),
        r AS (SELECT query_id, id, path, place0, CASE WHEN place0 <= 20 THEN exp(logit) / (1 + exp(logit)) ELSE score END AS score FROM d)
        SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY (place0 <= 20) DESC, CASE WHEN place0 > 20 THEN place0 END, round(score, 12) DESC, path, id) AS place FROM r""",
    "context_contents": f"{_CONTENTS} SELECT * FROM contents",
    "context_pack": f"{_PACK} SELECT query_id, place, path, chunk_symbol, body AS content, estimated_tokens, truncated FROM pk WHERE kept",
}
