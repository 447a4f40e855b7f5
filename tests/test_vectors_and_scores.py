import math

import numpy as np
from pyspark.sql import functions as F

from terrane.functions import scores as S
from terrane.functions import vectors as V
from terrane.operators import nearest


def vec(spark, *rows):
    return spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in rows], "a array<double>, b array<double>")


def test_cosine(spark):
    df = vec(spark, ((3, 4, 0), (30, 40, 0)), ((1, 0), (0, 1)), ((0, 0), (1, 1)), ((1, 2, 3), (1, 2)))
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_buckets_and_probes(spark):
    v = [0.9, 0.8, 0.7, 0.01, 0.6, 0.5, 0.4, 0.3, 0.2]
    near = list(v)
    near[3] = -near[3]
    df = vec(spark, (v, near))
    own, probes, other = df.select(V.bucket(F.col("a")), V.probes(F.col("a")), V.bucket(F.col("b"))).first()
    assert own == 255 and len(probes) == 9 and probes[0] == 255 and probes[1] == 255 ^ 8
    assert all(bin(p ^ own).count("1") == 1 for p in probes[1:]) and other != own and other in probes


def test_fnv():
    assert V.fnv1a64(["a", "", "参数"]).tolist() == [12638187200555641996, 14695981039346656037, _fnv("参数")]


def _fnv(term):
    h = 14695981039346656037
    for b in term.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None), (4, "Alpha Alpha beta")], "id long, text string")
    got = {r.id: np.array(r.vector) for r in V.hash_vectors(df, dimensions=64).collect()}
    want = np.zeros(64)
    for term, n in (("alpha", 2), ("beta", 1)):
        h = _fnv(term)
        want[h % 64] += -n if h >> 63 else n
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6) and np.allclose(got[4], got[1])
    assert not got[2].any() and not got[3].any()


def test_scores(spark):
    df = spark.createDataFrame([(r,) for r in (0, 1, 2, 60)], "r int")
    got = [x[0] for x in df.select(S.reciprocal_rank(F.col("r"))).collect()]
    assert got[0] == 0 and got[1] == 1.0 and got[1] > got[2] > got[3] > 0
    x = spark.createDataFrame([(-800.0,), (0.0,), (5.0,)], "x double").select(S.sigmoid(F.col("x"))).collect()
    assert x[0][0] == 0.0 and x[1][0] == 0.5 and math.isclose(x[2][0], 1 / (1 + math.exp(-5)))
    year = 365 * 86_400_000_000_000
    f = spark.createDataFrame([(year,), (0,), (2 * year,)], "m long").select(S.freshness(F.col("m"), year)).collect()
    assert [round(r[0], 9) for r in f] == [1.0, 0.5, 1.0]


def test_exact_and_probed_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0, 2.0]), (903, [float("nan")] * 16)]
    data = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 20)] + [(1000, [0.0] * 16)], "query_id long, vector array<float>")
    got = nearest.exact_topk(data, queries, 5, most_queries=4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        want = np.argsort(-(u @ u[q]), kind="stable")[:5]
        assert {r.id for r in got if r.query_id == q} == set(want.tolist())
    assert not [r for r in got if r.query_id == 1000]
    probed = nearest.probed_topk(data.filter("id < 900"), queries, 5, limit=1000).collect()
    assert {(r.query_id, r.id) for r in probed if r.cosine > 0.999} >= {(q, q) for q in range(0, 300, 20)}
    assert nearest.topk(data.filter("id < 900"), queries, 5, 1000, exact_limit=10).count() <= nearest.topk(data.filter("id < 900"), queries, 5, 1000).count()


def test_bytes_of_vectors(spark):
    df = spark.createDataFrame([([1.5, -2.0], 2), ([1.0], 2), (None, 2)], "v array<float>, n int")
    got = df.select(V.decode_vector(V.encode_vector(F.col("v")), F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == [[1.5, -2.0], None, None]
    assert df.select(V.encode_vector(F.col("v"))).first()[0] == np.array([1.5, -2.0], "<f4").tobytes()


def test_functions_in_sql(spark):
    from terrane.functions import text as X
    from terrane.plans.sqlfunctions import register

    assert "cosine_of" in register(spark)
    texts = ["S参数 索引_x", "Café load_vector", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT analyze_terms(t) AS a, index_tokens(t) AS i FROM texts").collect()
    want = df.select(X.analyze_terms(F.col("t")).alias("a"), X.index_tokens(F.col("t")).alias("i")).collect()
    assert got == want
    row = spark.sql("SELECT cosine_of(array(3F, 4F), array(30F, 40F)) AS a, cosine_of(array(1F), array(1F, 2F)) AS b, fts_match('the load_vector', 'is VECTOR') AS c, fts_match('the table', 'the is') AS d, within_path('/a/bc', '/a/b') AS e, fts_match('x load vector y', 'load_vector') AS f").first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (1.0, 0.0, True, False, False, True)
