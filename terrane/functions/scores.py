"""Scores of retrieval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
K1, B = 1.2, 0.75
_DAY_NS = 86_400_000_000_000


def reciprocal_rank(rank: Column) -> Column:
    """61 / (60 + rank), 1 for the first; 0 for what has no rank."""
    return F.when(rank > 0, F.lit(float(RRF_K + 1)) / (RRF_K + rank)).otherwise(0.0)


def freshness(mtime_ns: Column, now_ns: int) -> Column:
    """1 for now, one half after a year."""
    days = F.greatest(F.lit(0.0), (F.lit(now_ns) - mtime_ns) / F.lit(float(_DAY_NS)))
    return 1 / (1 + days / 365)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: Column, n: Column, df: Column) -> Column:
    """Contribution of one term to one document."""
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(F.lit(1.0), average)))
