"""Recall by vectors: exact, or by sign buckets and their probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.vectors import bucket, cosine, probes

#: Up to so many vectors all are compared.
EXACT_LIMIT = 20_000
#: Queries that are compared at once; bounds what a task holds.
_BLOCK = 2048


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "vector", query_id: str = "query_id", most_queries: int = 4096) -> DataFrame:
    """``query_id, id, cosine``: for each query the ``k`` vectors with the greatest positive cosine.

    The queries are a stated set and come in blocks of at most ``most_queries``, each of which is compared with every
    vector in one pass over the table; each task keeps the best k of its rows. Vectors of another length than the
    query's, zero and null vectors are no candidates. Ties go to the lower id.
    """
    ordered = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    total = ordered.count()
    blocks = max(1, -(-total // most_queries))
    parts = []
    for b in range(blocks):
        own = ordered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        ids = np.array([r["query_id"] for r in own], np.int64)
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r["vector"]) for r in own}:
            rows = [i for i, r in enumerate(own) if len(r["vector"]) == size]
            by_size[size] = (ids[rows], np.array([own[i]["vector"] for i in rows], np.float64))
        shared = vectors.sparkSession.sparkContext.broadcast(by_size)
        data = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL AND size(vector) > 0")
        parts.append(data.mapInArrow(_compare(shared, k), "query_id long, id long, cosine double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id"))
    return found.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def _compare(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy()
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for size, (query_ids, queries) in shared.value.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows) or size == 0:
                    continue
                data = flat[offsets[rows][:, None] + np.arange(size)]
                norms = np.linalg.norm(data, axis=1)
                ok = np.isfinite(norms) & (norms > 0)
                data, own = data[ok] / norms[ok, None], ids[rows][ok]
                if not len(own):
                    continue
                keep = min(k, len(own))
                for at in range(0, len(queries), _BLOCK):
                    q = queries[at : at + _BLOCK]
                    length = np.linalg.norm(q, axis=1, keepdims=True)
                    score = np.divide(q, length, out=np.zeros_like(q), where=length > 0) @ data.T
                    order = np.lexsort((np.broadcast_to(own, score.shape), -np.round(score, 9)), axis=1)[:, :keep]
                    value = np.take_along_axis(score, order, 1)
                    hit = np.round(value, 9) > 0  # less is rounding
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(query_ids[at : at + _BLOCK], hit.sum(1))), pa.array(own[order][hit]), pa.array(value[hit])],
                        ["query_id", "id", "cosine"],
                    )

    return run


def probed_topk(vectors: DataFrame, queries: DataFrame, k: int, limit: int, id: str = "id", vector: str = "vector", query_id: str = "query_id") -> DataFrame:
    """``query_id, id, cosine``: the same from the nine buckets that a query probes, at most nine times ``limit`` of them.

    A join on the bucket; of what it finds the lowest ids are kept before any cosine is computed.
    """
    data = vectors.filter(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v"), bucket(F.col(vector)).alias("bucket"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("q"), F.explode(F.array_distinct(probes(F.col(vector)))).alias("bucket"))
    candidates = data.join(asked, "bucket")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    kept = candidates.withColumn("_r", first).filter(F.col("_r") <= limit * 9)
    scored = kept.select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("cosine")).filter("round(cosine, 9) > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id"))
    return scored.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def capped_count(rows: DataFrame, most: int) -> int:
    """The number of rows, of which no more than one over ``most`` are counted."""
    return rows.limit(most + 1).count()


def topk(vectors: DataFrame, queries: DataFrame, k: int, limit: int, exact_limit: int = EXACT_LIMIT, **names: str) -> DataFrame:
    """Exact up to ``exact_limit`` vectors, by buckets beyond; no more than one row over the limit is counted."""
    if capped_count(vectors, exact_limit) <= exact_limit:
        return exact_topk(vectors, queries, k, **names)
    return probed_topk(vectors, queries, k, limit, **names)
