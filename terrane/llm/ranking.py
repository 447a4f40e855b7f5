"""One ranking from several differently scaled scores.

Each score becomes its empirical percentile within the query, ties averaged, then a normal score; an item's place
comes from the weighted mean of all of them, in which an unknown score stands at the query's middle, 0. So a known score
weighs the same in each row, and no score can dominate by its range, as only ranks go in.

A query of ordinary size is ranked by windows over its rows, all of them after one shuffle. A query of more than
``bucket_rows`` rows isn't sorted in one task: equal values are counted first, the distinct values are cut at
approximate quantiles into buckets, and a rank is the number of rows in lower buckets plus the rank within the bucket.
The cuts only spread the work; the ranks are exact either way and wherever they fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.tables import latest

SCORES = ("bm25_score", "vector_score", "metadata_score", "rerank_score")

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x: str, coefficients: Sequence[float]) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def normal_quantile_sql(p: str) -> str:
    """SQL text of the inverse normal distribution at ``p`` in (0, 1), for any engine; relative error below 1.2e-9."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"CASE WHEN {p} < {_LOW} THEN {_poly(low, _C)} / ({_poly(low, _D)} * {low} + 1) "
        f"WHEN {p} <= {1 - _LOW} THEN {_poly(r, _A)} * {q} / ({_poly(r, _B)} * {r} + 1) "
        f"ELSE -({_poly(high, _C)}) / ({_poly(high, _D)} * {high} + 1) END"
    )


def normal_quantile(p: Column) -> Column:
    """The inverse normal distribution at ``p`` in (0, 1); the same formula as a column."""
    def poly(x: Column, coefficients: Sequence[float]) -> Column:
        value = F.lit(coefficients[0])
        for c in coefficients[1:]:
            value = value * x + F.lit(c)
        return value

    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when(p < _LOW, poly(low, _C) / (poly(low, _D) * low + 1))
        .when(p <= 1 - _LOW, poly(r, _A) * q / (poly(r, _B) * r + 1))
        .otherwise(-poly(high, _C) / (poly(high, _D) * high + 1))
    )


def percentiles(rows: DataFrame, group: Sequence[str], value: str, bucket_rows: int = 100_000, cuts: int = 255) -> DataFrame:
    """``group, value, percentile`` for each distinct value of each group: (rows below + half the ties) / rows.

    Null and NaN values must be filtered out before. Groups with more than ``bucket_rows`` distinct values are cut
    into up to ``cuts + 1`` buckets.
    """
    group = list(group)
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_distinct"))
    large = sizes.filter(F.col("_distinct") > bucket_rows).select(*group)
    steps = [(i + 1) / (cuts + 1) for i in range(cuts)]
    bounds = (
        counts.join(large, group, "left_semi").groupBy(*group).agg(F.percentile_approx(value, steps, 20_000).alias("_bounds"))
    )
    placed = counts.join(bounds, group, "left").withColumn(
        "_bucket", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(value))), F.lit(0))
    )
    # one row a bucket: the window over a group sees at most cuts + 1 rows
    ordered = Window.partitionBy(*group).orderBy("_bucket")
    buckets = (
        placed.groupBy(*group, "_bucket")
        .agg(F.sum("_n").alias("_in"))
        .withColumn("_before", F.sum("_in").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_total", F.sum("_in").over(Window.partitionBy(*group)))
        .select(*group, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"), "_total")
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_below", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(buckets, [*group, "_bucket"])
        .select(*group, value, ((F.col("_before") + F.col("_below") + F.col("_n") / 2) / F.col("_total")).alias("percentile"))
    )


def fuse_scores(
    hits: DataFrame,
    query: str = "query_id",
    item: str = "file_id",
    scores: Sequence[str] = SCORES,
    weights: Mapping[str, float] | None = None,
    version: str = "served_at",
    bucket_rows: int = 100_000,
) -> DataFrame:
    """``query, item, fused, n_known``: one score for each current row of ``hits``; higher is better.

    Of the rows with one query and item the one with the greatest ``version`` counts. ``weights`` (default: alike)
    are those of the scores.

    Defined cases: a null or NaN score is unknown, neither low nor high, and counts as the middle of its query; a row without
    any known score has fused null and comes last; infinite scores are the least or greatest; a score that is known
    once in a query gives 0; tied scores share one percentile; rows with a null query or item are ignored; repeated
    rows count once; empty input gives an empty result. Extra columns are never read.
    """
    weights = {s: 1.0 for s in scores} | dict(weights or {})
    known = hits.filter(F.col(query).isNotNull() & F.col(item).isNotNull())
    # repeated rows are counted too, which may only spread a query that needn't be
    large = known.groupBy(F.col(query).alias("_q")).count().filter(F.col("count") > bucket_rows).select("_q")
    current = latest(known, [query, item], version, scores).select(
        F.col(query).alias("_q"),
        F.col(item).alias("_i"),
        # -0.0 and 0.0 tie
        *(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double") + 0.0).alias(f"_s{k}") for k, s in enumerate(scores)),
    )
    ranked = _by_windows(current.join(large, "_q", "left_anti"), len(scores)).unionByName(_by_buckets(current.join(large, "_q", "left_semi"), len(scores), bucket_rows))
    total = float(sum(weights[s] for s in scores)) or 1.0
    mean = sum(F.coalesce(normal_quantile(F.col(f"_p{k}")), F.lit(0.0)) * float(weights[s]) for k, s in enumerate(scores)) / total
    n_known = sum(F.col(f"_p{k}").isNotNull().cast("int") for k in range(len(scores)))
    return ranked.select(F.col("_q").alias(query), F.col("_i").alias(item), F.when(n_known > 0, mean).alias("fused"), n_known.alias("n_known"))


def _by_windows(rows: DataFrame, n: int) -> DataFrame:
    """``_q, _i`` and the percentile of each score, null where it is unknown."""
    whole = Window.partitionBy("_q")
    size = F.count(F.lit(1)).over(whole)
    out = rows.withColumn("_size", size)
    for k in range(n):
        ordered = Window.partitionBy("_q").orderBy(f"_s{k}")  # unknown ones first
        below_or_unknown = F.rank().over(ordered) - 1
        up_to = F.round(F.cume_dist().over(ordered) * F.col("_size"))
        unknown = F.col("_size") - F.count(f"_s{k}").over(whole)
        percentile = ((below_or_unknown + up_to) / 2 - unknown) / (F.col("_size") - unknown)
        out = out.withColumn(f"_p{k}", F.when(F.col(f"_s{k}").isNotNull(), percentile))
    return out.select("_q", "_i", *(f"_p{k}" for k in range(n)))


def _by_buckets(rows: DataFrame, n: int, bucket_rows: int) -> DataFrame:
    """The same for queries of any size."""
    entries = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_s{k}").alias("value")) for k in range(n)))
    long = rows.select("_q", "_i", F.explode(entries).alias("e")).select("_q", "_i", "e.kind", "e.value")
    known = long.filter("value IS NOT NULL")
    scored = known.join(percentiles(known, ["_q", "kind"], "value", bucket_rows), ["_q", "kind", "value"]).select("_q", "_i", "kind", "percentile")
    # every row once more, as it may have no known score
    scored = scored.unionByName(rows.select("_q", "_i", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("double").alias("percentile")))
    return scored.groupBy("_q", "_i").agg(*(F.max(F.when(F.col("kind") == k, F.col("percentile"))).alias(f"_p{k}") for k in range(n)))


def top_items(fused: DataFrame, query: str = "query_id", item: str = "file_id", k: int = 5) -> DataFrame:
    """The ``k`` highest items of each query with their ``place`` from 1; ties go to the lower item.

    Spark keeps k rows of a query in each task before the shuffle, so the size of a query doesn't matter.
    """
    order = Window.partitionBy(query).orderBy(F.round("fused", 9).desc_nulls_last(), F.col(item))
    return fused.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
