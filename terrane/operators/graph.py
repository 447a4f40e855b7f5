"""Concepts and their co-occurrence graph, and the graph of symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import concept_words, headings

MOST_TERMS = 10


def extract_concepts(chunks: DataFrame, id: str = "id", text: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """``chunk_id, pos, name, kind`` and the columns ``keep`` of a chunk: headings of a chunk first, then its most frequent words that occur at least twice.

    A name that is both is a heading. Of equally frequent words the lower comes first. ``pos`` counts from 0.
    """
    chunk = ["chunk_id", *keep]
    source = chunks.filter(F.col(text).isNotNull()).select(F.col(id).alias("chunk_id"), *keep, F.col(text).alias("t"))
    heads = source.select(*chunk, F.posexplode(headings(F.col("t"))).alias("pos", "name"))
    counts = source.select(*chunk, F.explode(concept_words(F.col("t"))).alias("name")).groupBy(*chunk, "name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    place = F.row_number().over(Window.partitionBy(*chunk).orderBy(F.desc("n"), "name"))
    terms = counts.withColumn("r", place).filter(F.col("r") <= MOST_TERMS)
    both = heads.select(*chunk, "name", F.lit("heading").alias("kind"), F.col("pos").alias("o")).unionByName(
        terms.select(*chunk, "name", F.lit("term").alias("kind"), (F.col("r") + 1_000_000).alias("o"))
    )
    first = both.groupBy(*chunk, "name").agg(F.min_by("kind", "o").alias("kind"), F.min("o").alias("o"))
    pos = F.row_number().over(Window.partitionBy(*chunk).orderBy("o")) - 1
    return first.withColumn("pos", pos).select("chunk_id", "pos", "name", "kind", *keep)


def concept_nodes(extracted: DataFrame) -> DataFrame:
    """``name, kind, doc_count``: each concept once, its kind that of its first occurrence."""
    first = F.struct("chunk_id", "pos")
    return extracted.groupBy("name").agg(F.min_by("kind", first).alias("kind"), F.count_distinct("chunk_id").alias("doc_count"))


def edges(occurrences: DataFrame) -> DataFrame:
    """``src < dst, co_count``: in how many chunks both occur.

    A chunk's concepts are gathered once; what is sent is counted before. For many or large chunks, and with a
    measure against chance, see the pair counts by stripes.
    """
    clean = occurrences.select("concept_id", "chunk_id").dropna()
    sets = clean.groupBy("chunk_id").agg(F.sort_array(F.collect_set("concept_id")).alias("c"))
    # pairs are made within the row; the array itself is not repeated for each element
    each = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    pairs = sets.select(F.explode(each).alias("p")).select("p.src", "p.dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("co_count"))


def edges_around(occurrences: DataFrame, start: DataFrame) -> DataFrame:
    """``src, dst, co_count``: the edges of the concepts ``start`` (id) only, from each to its neighbours.

    Only the chunks of these concepts are read, so a single name costs as much as it occurs and not the whole graph.
    """
    clean = occurrences.select("concept_id", "chunk_id").dropna().distinct()
    own = clean.join(start.select(F.col("id").alias("concept_id")).distinct(), "concept_id", "left_semi").select(F.col("concept_id").alias("src"), "chunk_id")
    near = own.join(clean.select(F.col("concept_id").alias("dst"), "chunk_id"), "chunk_id").filter("src <> dst")
    return near.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("co_count"))


def both_ways(edge: DataFrame) -> DataFrame:
    """Undirected edges, once in each direction."""
    return edge.select("src", "dst", "co_count").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "co_count"))


def doc_counts(occurrences: DataFrame) -> DataFrame:
    """``id, doc_count``: in how many chunks a concept occurs, from the occurrences and not from what was stored."""
    return occurrences.select(F.col("concept_id").alias("id"), "chunk_id").dropna().distinct().groupBy("id").agg(F.count(F.lit(1)).alias("doc_count"))


def related(names: DataFrame, concepts: DataFrame, edge: DataFrame, counts: DataFrame, limit: int = 20, directed: bool = False) -> DataFrame:
    """``name, related, co_count, score``: for each name the concepts it occurs with, by co * (ln co - ln count).

    ``edge`` are undirected edges, or with ``directed`` those of :func:`edges_around` the names.
    """
    start = names.select("name").distinct().join(concepts.select("name", F.col("id").alias("src")), "name")
    around = start.join(edge if directed else both_ways(edge), "src").join(concepts.select(F.col("id").alias("dst"), F.col("name").alias("related")), "dst").join(counts.select(F.col("id").alias("dst"), "doc_count"), "dst")
    score = F.col("co_count") * (F.ln("co_count") - F.ln("doc_count"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.round("score", 9)), F.desc("co_count"), "related"))
    return around.withColumn("score", score).withColumn("place", place).filter(F.col("place") <= limit).select("name", "related", "co_count", "score", "place")


def concept_occurrences(names: DataFrame, concepts: DataFrame, occurrences: DataFrame, chunks: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """``name, path, symbol, start_line, end_line``: where each name occurs, by path and line, up to ``limit``."""
    start = names.select("name").distinct().join(concepts.select("name", F.col("id").alias("concept_id")), "name")
    found = (
        start.join(occurrences.select("concept_id", "chunk_id").dropna().distinct(), "concept_id")
        .join(chunks.select(F.col("id").alias("chunk_id"), "file_id", "symbol", "start_line", "end_line"), "chunk_id")
        .join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    )
    place = F.row_number().over(Window.partitionBy("name").orderBy("path", "start_line", "chunk_id"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("name", "path", "symbol", "start_line", "end_line", "place")


def without_chunks(occurrences: DataFrame, gone: DataFrame) -> DataFrame:
    """Occurrences without those of some chunks; counts and edges follow from what is left."""
    return occurrences.join(gone.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_anti")


def callers(references: DataFrame, symbol: str) -> DataFrame:
    """Who calls a symbol, and where."""
    return references.filter(F.col("callee_symbol") == symbol).select("file_id", "caller_symbol", "line").orderBy("file_id", "line")


def callees(references: DataFrame, symbol: str) -> DataFrame:
    """What a symbol calls, and where."""
    return references.filter(F.col("caller_symbol") == symbol).select("file_id", "callee_symbol", "line").orderBy("file_id", "line")
