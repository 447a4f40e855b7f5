"""Hybrid search for a whole table of queries at once.

Every arm gives ``query_id, id`` and a rank: words in files, words in chunks, vectors of files and chunks, neighbours in
the concept graph, and the newest files of a filter. All statistics, ranks and limits are per query, so one plan answers
any number of them. The ranks are fused by their reciprocals, so arms with different scores can be added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.durable import written
from terrane.functions.scores import bm25, freshness, reciprocal_rank, sigmoid
from terrane.functions.text import analyze_terms, compact_snippet, distinct_terms, text_or_empty
from terrane.operators import inverted
from terrane.operators.relational import metadata_filter

#: Weights of words, vectors, age and concepts.
WEIGHTS = {"words": 0.52, "vectors": 0.38, "age": 0.10, "concepts": 0.0}
CONCEPT_WEIGHTS = {"words": 0.47, "vectors": 0.34, "age": 0.09, "concepts": 0.10}
_NEAR = "struct<snippet:string,chunk_symbol:string,start_line:bigint,end_line:bigint>"
SNIPPET_BYTES, RERANK_BYTES, RERANK_MOST = 320, 1800, 50


@dataclass(frozen=True)
class Request:
    """Limits and filters that all queries of a table share."""

    limit: int = 20
    kinds: Sequence[str] = ()
    tags: Sequence[str] = ()
    path_prefix: str = ""
    min_size: int = 0
    max_size: int = 0

    @property
    def bounded(self) -> int:
        return min(self.limit if self.limit > 0 else 20, 200)

    @property
    def candidates(self) -> int:
        """How many rows an arm may recall for a query."""
        return max(256, 12 * self.bounded)

    @property
    def condition(self) -> Column:
        return metadata_filter(self.kinds, self.tags, self.path_prefix, self.min_size, self.max_size)

    @property
    def filters(self) -> bool:
        return bool(self.kinds or self.tags or self.path_prefix)


def file_input() -> Column:
    """What is embedded of a file."""
    return F.concat_ws("\n", "name", "path", "content_head")


def chunk_input() -> Column:
    """What is embedded of a chunk."""
    return F.concat_ws("\n", "symbol", "content")


def local_bm25(recalled: DataFrame, rows: DataFrame, queries: DataFrame, text: Column, id: str = "id") -> DataFrame:
    """``query_id, id, score`` of what was recalled, with the frequencies and lengths of a query's recalled rows only.

    A row's text is analysed once, however many queries recalled it, and only the queries' words of it are kept.
    """
    needed = rows.join(recalled.select(F.col("id").alias(id)).distinct(), id, "left_semi").select(F.col(id).alias("id"), analyze_terms(text).alias("terms"))
    needed = written(needed, "recalled")  # analysed once; at most what the arm may recall
    asked = queries.select("query_id", F.explode(distinct_terms(analyze_terms(F.col("query_text")))).alias("term"))
    vocabulary = asked.select("term").distinct()
    tf = needed.select("id", F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    # the windows see at most the recalled rows of one query
    corpus, word = Window.partitionBy("query_id"), Window.partitionBy("query_id", "term")
    known = recalled.join(needed.select("id", F.size("terms").alias("length")), "id").withColumn("n", F.count(F.lit(1)).over(corpus)).withColumn("average", F.avg("length").over(corpus))
    hits = known.join(asked, "query_id").join(tf, ["id", "term"]).withColumn("df", F.count(F.lit(1)).over(word))
    weight = bm25(F.col("tf"), F.col("length"), F.col("average"), F.col("n"), F.col("df"))
    scored = hits.groupBy("query_id", "id").agg(F.sum(weight).alias("score"))
    # what was recalled by the index may hold no word of the analyser: it has score 0, yet a rank
    return recalled.join(scored, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _ranked(scored: DataFrame, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *ties)
    return scored.withColumn("rank", F.row_number().over(order))


def file_words(files: DataFrame, queries: DataFrame, limit: int, index: DataFrame | None = None) -> DataFrame:
    """``query_id, id, rank, snippet``: files by words of their name, path, tags and content.

    ``index`` holds the postings of the files; without it they are made of all files.
    """
    index = inverted.postings(files, inverted.FILE_FIELDS) if index is None else index
    found = written(inverted.recalled(index, inverted.query_phrases(queries), limit), "recall")  # small, and read often
    text = F.concat_ws(" ", *(text_or_empty(F.col(c)) for c in ("name", "path", "tags_text", "content_head")))
    scored = local_bm25(found, files, queries, text).join(files.select("id", "path", compact_snippet(F.col("content_head"), SNIPPET_BYTES).alias("snippet")), "id")
    return _ranked(scored, "path", "id").select("query_id", "id", "rank", "snippet")


def chunk_words(chunks: DataFrame, files: DataFrame, queries: DataFrame, limit: int, index: DataFrame | None = None) -> DataFrame:
    """``query_id, id (of the file), rank, snippet, chunk_symbol, start_line, end_line``: each file's best chunk by words.

    Ranks count chunks, not files. ``index`` holds the postings of the chunks; without it they are made of all chunks.
    """
    index = inverted.postings(chunks, inverted.CHUNK_FIELDS) if index is None else index
    found = written(inverted.recalled(index, inverted.query_phrases(queries), limit), "recall")
    text = F.concat_ws(" ", text_or_empty(F.col("symbol")), text_or_empty(F.col("content")))
    place = chunks.select(F.col("id").alias("chunk_id"), "file_id", "symbol", "start_line", "end_line", "content")
    scored = (
        local_bm25(found, chunks, queries, text)
        .withColumnRenamed("id", "chunk_id")
        .join(place, "chunk_id")
        .join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    )
    ranked = _ranked(scored, "path", "chunk_id")
    best = ranked.groupBy("query_id", F.col("file_id").alias("id")).agg(F.min_by(F.struct("rank", "content", "symbol", "start_line", "end_line"), "rank").alias("b"))
    return best.select("query_id", "id", "b.rank", F.col("b.content").alias("snippet"), text_or_empty(F.col("b.symbol")).alias("chunk_symbol"), "b.start_line", "b.end_line")


def chunk_vectors(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, id (of the file), cosine, snippet, chunk_symbol, start_line, end_line``: each file's nearest chunk.

    ``found`` is ``query_id, id (of the chunk), cosine``; of equally near chunks the one with the lower id counts.
    """
    place = chunks.select("id", "file_id", F.struct(F.col("content").alias("snippet"), text_or_empty(F.col("symbol")).alias("chunk_symbol"), "start_line", "end_line").alias("place"))
    order = F.struct(-F.round("cosine", 9), "id")
    best = found.join(place, "id").groupBy("query_id", F.col("file_id").alias("id")).agg(F.max("cosine").alias("cosine"), F.min_by("place", order).alias("place"))
    return best.select("query_id", "id", "cosine", "place.*")


def newest(files: DataFrame, queries: DataFrame, request: Request) -> DataFrame:
    """``query_id, id``: for each query the most recently changed files of the request's filter."""
    chosen = files.filter(request.condition).orderBy(F.desc("mtime_ns"), "id").limit(request.candidates).select("id")
    # one array of at most as many ids as an arm may recall, the same for every query
    ids = chosen.agg(F.collect_list("id").alias("ids")).scalar()
    return queries.select("query_id").withColumn("ids", ids).select("query_id", F.explode("ids").alias("id"))


def named_concepts(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """``query_id, src``: the concepts whose names, of one word or several, stand in a query.

    Both are read as concept words; a name is sought among the runs of words of a query that are as long as some name.
    """
    from terrane.functions.text import concept_words

    names = concepts.select(concept_words(F.col("name")).alias("n"), F.col("id").alias("src")).filter(F.size("n") > 0)
    longest = names.agg(F.max(F.size("n"))).first()[0] or 1
    words = queries.select("query_id", concept_words(F.col("query_text")).alias("w")).filter(F.size("w") > 0)
    runs = F.flatten(F.transform("w", lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i)), lambda k: F.array_join(F.slice("w", i + 1, k), " "))))
    named = words.select("query_id", F.explode(F.array_distinct(runs)).alias("name"))
    return named.join(names.select(F.array_join("n", " ").alias("name"), "src"), "name").select("query_id", "src").distinct()


def concept_neighbours(queries: DataFrame, concepts: DataFrame, edges: DataFrame | None, occurrences: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """``query_id, id (of the file), rank``: files with neighbours, in the concept graph, of the concepts a query names.

    Files are ranked by the number of distinct neighbours. ``edges`` are undirected; without them the neighbours come from
    the chunks of the named concepts.
    """
    from terrane.operators.graph import both_ways, edges_around

    start = named_concepts(queries, concepts)
    graph = edges_around(occurrences, start.select(F.col("src").alias("id"))) if edges is None else both_ways(edges)
    around = start.join(graph, "src").select("query_id", F.col("dst").alias("concept_id")).distinct()
    where = occurrences.select("concept_id", "chunk_id").dropna().distinct().join(chunks.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").select("concept_id", F.col("file_id").alias("id")).distinct()
    strength = around.join(where, "concept_id").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("strength"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("strength"), "id"))
    return strength.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "id", "rank", "strength")


def fuse(
    queries: DataFrame,
    files: DataFrame,
    request: Request,
    now_ns: int,
    words: DataFrame | None = None,
    chunk: DataFrame | None = None,
    vectors: DataFrame | None = None,
    concepts: DataFrame | None = None,
    metadata: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    near_chunks: DataFrame | None = None,
) -> DataFrame:
    """Merges the arms and ranks: ``query_id, id, path, ..., score, bm25_score, vector_score, metadata_score``.

    A chunk's rank replaces a file's if it is as good, and then the chunk is shown. ``vectors`` holds
    ``query_id, id, cosine`` of files, ``near_chunks`` the rows of :func:`chunk_vectors`: a chunk that is nearer than its file
    gives the file its cosine, and is shown where no words were found. Filters apply to what every arm
    recalled, after its limit. A candidate of a query with text that no arm but the newest files knows is dropped.
    """
    weights = weights or (CONCEPT_WEIGHTS if concepts is not None else WEIGHTS)
    none = F.lit(None)
    columns = {"words": "int", "snippet": "string", "chunk_rank": "int", "chunk_snippet": "string", "chunk_symbol": "string", "start_line": "long", "end_line": "long", "cosine": "double", "concept_rank": "int", "near_cosine": "double", "near": _NEAR}

    def arm(df: DataFrame | None, **given: str) -> DataFrame | None:
        return None if df is None else df.select("query_id", "id", *((F.col(given[c]) if c in given else none).cast(t).alias(c) for c, t in columns.items()))

    arms = [
        arm(words, words="rank", snippet="snippet"),
        arm(chunk, chunk_rank="rank", chunk_snippet="snippet", chunk_symbol="chunk_symbol", start_line="start_line", end_line="end_line"),
        arm(vectors, cosine="cosine"),
        None if near_chunks is None else arm(near_chunks.withColumn("near", F.struct("snippet", "chunk_symbol", "start_line", "end_line")), near_cosine="cosine", near="near"),
        arm(concepts, concept_rank="rank"),
        arm(metadata),
    ]
    arms = [a for a in arms if a is not None]
    union = arms[0]
    for a in arms[1:]:
        union = union.unionByName(a)
    # at most one row of each arm has a value in its columns, the vectors' aside
    merged = union.groupBy("query_id", "id").agg(*((F.max(c) if c in ("cosine", "near_cosine") else F.first(c, ignorenulls=True)).alias(c) for c in columns))
    chunk_wins = F.col("chunk_rank").isNotNull() & (F.col("words").isNull() | (F.col("chunk_rank") <= F.col("words")))
    lex = F.when(chunk_wins, F.col("chunk_rank")).otherwise(F.coalesce("words", F.lit(0)))
    # the nearest chunk is shown where words rank neither the file nor any chunk
    near_wins = F.col("near_cosine").isNotNull() & (F.col("cosine").isNull() | (F.round("near_cosine", 9) > F.round("cosine", 9)))
    near_shown = near_wins & (lex == 0)

    def shown(by_chunk: str, near: str, otherwise) -> Column:
        return F.when(chunk_wins, F.col(by_chunk)).when(near_shown, F.col(f"near.{near}")).otherwise(otherwise)

    info = files.select("id", "path", "kind", "size", "mtime_ns", "mime", "tags_text")
    has_text = queries.select("query_id", (F.trim("query_text") != "").alias("has_text"))
    candidates = (
        merged.withColumn("lex", lex)
        .withColumn("snippet", shown("chunk_snippet", "snippet", F.coalesce("snippet", F.lit(""))))
        .withColumn("chunk_symbol", shown("chunk_symbol", "chunk_symbol", F.lit("")))
        .withColumn("start_line", shown("start_line", "start_line", F.lit(0)))
        .withColumn("end_line", shown("end_line", "end_line", F.lit(0)))
        .withColumn("vector_score", F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0)), F.coalesce("near_cosine", F.lit(0.0))))
        .withColumn("concept_rank", F.coalesce("concept_rank", F.lit(0)))
        .join(info, "id")
        .join(has_text, "query_id")
        .filter(request.condition)
        .filter(~F.col("has_text") | (F.col("lex") > 0) | (F.col("vector_score") > 0) | (F.col("concept_rank") > 0))
    )
    by_vector = Window.partitionBy("query_id", F.col("vector_score") > 0).orderBy(F.desc(F.round("vector_score", 9)), "path", "id")
    vector_rank = F.when(F.col("vector_score") > 0, F.row_number().over(by_vector)).otherwise(0)
    scored = (
        candidates.withColumn("vector_rank", vector_rank)
        .withColumn("bm25_score", reciprocal_rank(F.col("lex")))
        .withColumn("metadata_score", freshness(F.col("mtime_ns"), now_ns))
    )
    score = (
        weights["words"] * F.col("bm25_score")
        + weights["vectors"] * reciprocal_rank(F.col("vector_rank"))
        + weights["age"] * F.col("metadata_score")
        + weights["concepts"] * reciprocal_rank(F.col("concept_rank"))
    )
    return scored.withColumn("score", score).select(
        "query_id", "id", "path", "kind", "size", "mtime_ns", "mime", "snippet", "chunk_symbol", "start_line", "end_line", "score", "bm25_score", "vector_score", "metadata_score", "vector_rank", "concept_rank"
    )


def placed(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """``hits`` with their ``place`` in the query's result, by score and path, up to ``limit``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path", "id")
    out = hits.withColumn("place", F.row_number().over(order))
    return out if limit is None else out.filter(F.col("place") <= limit)


def hybrid_search(
    queries: DataFrame,
    files: DataFrame,
    chunks: DataFrame,
    request: Request,
    now_ns: int,
    vectors: DataFrame | None = None,
    concepts: DataFrame | None = None,
    reranker: Callable[[str, list[str]], list[float]] | None = None,
    near_chunks: DataFrame | None = None,
    file_index: DataFrame | None = None,
    chunk_index: DataFrame | None = None,
) -> DataFrame:
    """The first ``request.limit`` hits of each query of ``queries`` (query_id, query_text), with their places.

    ``files`` is the current state of the files, ``chunks`` has each id once. ``vectors``, ``near_chunks`` and ``concepts`` are
    results of the other arms; without them these don't take part. The indexes are stored postings of files and chunks. A request with neither text nor filter is an error.
    """
    texts = queries.select(F.col("query_id"), F.trim(text_or_empty(F.col("query_text"))).alias("query_text"))
    if not request.filters and not texts.filter("query_text = ''").isEmpty():
        raise ValueError("a search needs a query or a filter")
    # an arm's result is at most request.candidates rows a query, so it is cheap to keep and lets the plan of the
    # fusion stay small
    hits = placed(
        fuse(
            texts,
            files,
            request,
            now_ns,
            words=written(file_words(files, texts, request.candidates, file_index), "arm"),
            chunk=written(chunk_words(chunks, files, texts, request.candidates, chunk_index), "arm"),
            vectors=None if vectors is None else written(vectors, "arm"),
            concepts=None if concepts is None else written(concepts, "arm"),
            metadata=newest(files, texts, request),
            near_chunks=None if near_chunks is None else written(near_chunks, "arm"),
        )
    )
    if reranker is not None:
        hits = rerank(hits, texts, request.bounded, reranker)
    return hits.filter(F.col("place") <= request.bounded)


def rerank_window(limit: int) -> int:
    return min(max(2 * limit, 10), RERANK_MOST)


def rerank(hits: DataFrame, queries: DataFrame, limit: int, scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """Rescores the first hits of each query; those beyond the window stay behind them in their order.

    ``scorer`` takes a query and documents and gives one logit for each; a query on which it fails keeps its order.
    At most ``min(max(2 * limit, 10), 50)`` documents of a query leave the JVM.
    """
    import pandas as pd

    window = rerank_window(limit)
    document = F.when(F.col("snippet") != "", F.col("snippet")).otherwise(F.col("path"))
    document = compact_snippet(F.when(F.col("chunk_symbol") != "", F.concat_ws("\n", "chunk_symbol", document)).otherwise(document), RERANK_BYTES)
    head = hits.filter(F.col("place") <= window).select("query_id", "id", "place", document.alias("document")).join(queries, "query_id")

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        try:
            logits = [float(x) for x in scorer(frame["query_text"].iloc[0], frame["document"].tolist())]
            if len(logits) != len(frame):
                raise ValueError("one score for each document is needed")
        except Exception:  # reranking refines; the first ranking stands without it
            logits = [float("nan")] * len(frame)
        return pd.DataFrame({"query_id": frame["query_id"], "id": frame["id"], "logit": logits})

    logits = head.groupBy("query_id").applyInPandas(score, "query_id long, id long, logit double")
    joined = hits.join(logits, ["query_id", "id"], "left")
    known = F.col("logit").isNotNull() & ~F.isnan("logit")
    rescored = joined.withColumn("rerank_score", F.when(known, sigmoid(F.col("logit")))).withColumn("score", F.coalesce("rerank_score", "score"))
    order = Window.partitionBy("query_id").orderBy((F.col("place") <= window).desc(), F.when(F.col("place") > window, F.col("place")), F.desc(F.round("score", 12)), "path", "id")
    return rescored.withColumn("place", F.row_number().over(order)).drop("logit")
