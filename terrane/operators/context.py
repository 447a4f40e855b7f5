"""Context packs: the contents of hits, trimmed to a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import text_or_empty, trim_space

DEFAULT_BUDGET, MOST_BUDGET, BYTES_PER_TOKEN, CHUNKS_PER_HIT = 4000, 32_000, 4, 6


def hit_contents(hits: DataFrame, chunks: DataFrame, files: DataFrame, per_hit: int = CHUNKS_PER_HIT) -> DataFrame:
    """``query_id, id, content``: up to ``per_hit`` chunks of each hit, in the order of the file.

    Chosen are those of the hit's symbol, then the nearest by line, then the first. A file without chunks gives its
    snippet, or the beginning of its content.
    """
    near = hits.select("query_id", "id", "chunk_symbol", F.col("start_line").alias("at")).join(
        chunks.select(F.col("file_id").alias("id"), "ordinal", F.col("id").alias("chunk_id"), text_or_empty(F.col("symbol")).alias("symbol"), "start_line", "end_line", text_or_empty(F.col("content")).alias("body")), "id"
    )
    same = F.when((F.col("symbol") == F.col("chunk_symbol")) & (F.col("chunk_symbol") != ""), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(same, F.abs(F.col("start_line") - F.col("at")), "ordinal", "chunk_id"))
    chosen = near.withColumn("r", place).filter(F.col("r") <= per_hit)
    head = F.when(F.col("symbol") != "", F.format_string("// %s lines %d-%d\n", "symbol", "start_line", "end_line")).otherwise("")
    parts = chosen.groupBy("query_id", "id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id", F.concat(head, "body").alias("text")))).alias("p"))
    joined = parts.select("query_id", "id", F.array_join("p.text", "\n\n").alias("content"))
    whole = hits.select("query_id", "id", "snippet").join(joined, ["query_id", "id"], "left").join(files.select("id", "content_head"), "id", "left")
    return whole.select("query_id", "id", F.coalesce(F.nullif("content", F.lit("")), F.nullif("snippet", F.lit("")), text_or_empty(F.col("content_head"))).alias("content"))


def context_pack(hits: DataFrame, contents: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """``query_id, place, path, ..., content, estimated_tokens, truncated``: items of each query's pack, in its order.

    Each item costs its path, a line feed and its content, in bytes; the item at which the budget of four bytes a token
    runs out is cut at a character, and the rest is left out. ``estimated_tokens`` and ``truncated`` are the pack's.
    """
    budget = min(budget if budget > 0 else DEFAULT_BUDGET, MOST_BUDGET)
    total = budget * BYTES_PER_TOKEN
    rows = hits.join(contents, ["query_id", "id"]).withColumn("content", trim_space(text_or_empty(F.col("content"))))
    head = F.octet_length("path") + 1
    full = head + F.octet_length("content")
    order = Window.partitionBy("query_id").orderBy("place")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = rows.withColumn("_head", head.cast("long")).withColumn("_before", before).withColumn("_room", F.lit(total) - F.col("_before") - F.col("_head"))
    kept = F.col("_room") > 0
    cut = F.when(F.octet_length("content") > F.col("_room"), _cut_bytes(F.col("content"), F.col("_room"))).otherwise(F.col("content"))
    marked = spent.withColumn("_kept", kept).withColumn("_cut", kept & (F.octet_length("content") > F.col("_room"))).withColumn("content", F.when(kept, cut))
    whole = Window.partitionBy("query_id")
    used = F.sum(F.when(F.col("_kept"), F.col("_head") + F.octet_length("content")).otherwise(0)).over(whole)
    # an item without room is reached, and so counts as cut, unless the one before took exactly the rest
    missed = F.max((~F.col("_kept") & (F.col("_before") < total)).cast("int")).over(whole)
    out = (
        marked.withColumn("estimated_tokens", F.floor((F.least(used, F.lit(total)) + 3) / 4).cast("long"))
        .withColumn("truncated", (F.max(F.col("_cut").cast("int")).over(whole) + missed) > 0)
        .filter("_kept")
    )
    return out.select("query_id", "place", "path", "kind", "score", "chunk_symbol", "start_line", "end_line", "content", "estimated_tokens", "truncated")


def _cut_bytes(c: Column, limit: Column) -> Column:
    """The longest beginning of at most ``limit`` bytes, never half a character."""
    data = F.encode(c, "UTF-8")
    cuts = [F.substring(data, F.lit(1), F.greatest(F.lit(0), limit - back).cast("int")).cast("string") for back in range(4)]
    return F.coalesce(*(F.when(F.is_valid_utf8(x), x) for x in cuts))
