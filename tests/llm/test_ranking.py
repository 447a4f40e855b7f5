import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from terrane.llm.ranking import SCORES, fuse_scores, normal_quantile, percentiles, top_items

T0 = datetime(2025, 1, 1)
_SCHEMA = "query_id long, file_id long, served_at timestamp, " + ", ".join(f"{s} double" for s in SCORES) + ", value string, kind string"


def known(x):
    return x is not None and not math.isnan(x)


def brute(rows):
    now = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and (r[:2] not in now or r[2] > now[r[:2]][2]):
            now[r[:2]] = r
    out = defaultdict(list)
    for i in range(len(SCORES)):
        groups = defaultdict(list)
        for k, r in now.items():
            if known(r[3 + i]):
                groups[k[0]].append((k, r[3 + i] + 0.0))
        for own in groups.values():
            for k, v in own:
                p = (sum(x < v for _, x in own) + sum(x == v for _, x in own) / 2) / len(own)
                out[k].append(NormalDist().inv_cdf(p))
    return {k: sum(out[k]) / len(SCORES) if out[k] else None for k in now}  # an unknown score is the middle, 0


@pytest.mark.parametrize("bucket_rows", [100_000, 4])
def test_against_brute_force(spark, bucket_rows):
    rng = random.Random(1)
    rows = []
    for q, n in ((1, 150), (2, 7), (3, 1)):
        for f in range(n):
            scores = [rng.gauss(0, 1), rng.choice([0.0, -0.0, 0.5, 1.0]), 10 ** rng.uniform(-9, 9), None if f % 3 else rng.random()]
            if f % 11 == 0:
                scores[0] = float("nan")
            if f == 5:
                scores = [None, float("nan"), None, None]
            if f == 6:
                scores[2] = float("inf")
            rows.append((q, f, T0 + timedelta(seconds=f), *scores))
            if f % 4 == 0:
                rows.append((q, f, T0 - timedelta(days=1), *[x and x * 7 for x in scores]))
            if f % 5 == 0:
                rows.append(rows[-1])
    rows += [(None, 1, T0, 1.0, 1.0, 1.0, 1.0), (1, None, T0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], _SCHEMA)
    got = {(r.query_id, r.file_id): r.fused for r in fuse_scores(df, bucket_rows=bucket_rows).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None)
        assert v is None or math.isclose(got[k], v, abs_tol=1e-7), k
    top = top_items(fuse_scores(df, bucket_rows=bucket_rows)).collect()
    assert {r.query_id: r.file_id for r in top if r.place == 1} == {q: min((-round(v, 9) if v is not None else 9, k[1]) for k, v in want.items() if k[0] == q)[1] for q in (1, 2, 3)}


def test_scales_do_not_matter(spark):
    rows = [(1, f, T0, float(f), float(f) * 1e6 + 3, math.exp(-f), 0.5, "", "") for f in range(9)]
    a = fuse_scores(spark.createDataFrame(rows, _SCHEMA))
    b = fuse_scores(spark.createDataFrame([(*r[:3], r[3] * 1e9 - 4, r[4] ** 3, r[5], r[6], "", "") for r in rows], _SCHEMA))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    for p, z in zip(ps, got, strict=True):
        assert math.isclose(z, NormalDist().inv_cdf(p), rel_tol=2e-8, abs_tol=1e-9)


def test_weights_and_empty(spark):
    df = spark.createDataFrame([(1, f, T0, float(f), float(-f), None, None, "", "") for f in range(4)], _SCHEMA)
    assert top_items(fuse_scores(df, weights={"vector_score": 0.0}), k=1).first().file_id == 3
    assert top_items(fuse_scores(df, weights={"bm25_score": 0.0}), k=1).first().file_id == 0
    assert fuse_scores(df.limit(0)).count() == 0


def test_a_known_score_weighs_the_same_in_each_row(spark):
    """A file that is best in its only known score doesn't stand above one that is nearly best in all four."""
    rows = [(1, f, T0, float(f), float(f), float(f), float(f), "", "") for f in range(20)] + [(1, 99, T0, 100.0, None, None, float("nan"), "", "")]
    fused = {r.file_id: r for r in fuse_scores(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert fused[99].n_known == 1 and fused[10].fused < fused[99].fused < fused[19].fused


def test_percentiles_of_ties(spark):
    df = spark.createDataFrame([(1, 5.0)] * 3 + [(1, 7.0)], "g long, v double")
    assert sorted((r.v, r.percentile) for r in percentiles(df, ["g"], "v").collect()) == [(5.0, 0.375), (7.0, 0.875)]
