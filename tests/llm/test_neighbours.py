import numpy as np
import pytest

from terrane.llm import neighbours as N

_SCHEMA = "file_id long, model string, dimensions int, vector array<float>, updated_at_ns long, id long, cosine string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], _SCHEMA)


def exact(x, ids, k=10):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {int(i): {int(ids[j]) for j in o} for i, o in zip(ids, order, strict=True)}, s


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 200, "block_rows": 150, "part_rows": 300, "candidates": 64}, {"leaf_rows": 40, "block_rows": 150, "centres": (8, 6)}])
def test_recall_of_random_and_clustered_vectors(spark, sizes):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([rng.normal(size=(600, 32)), centres[rng.integers(40, size=900)] + 0.3 * rng.normal(size=(900, 32))]).astype(np.float32)
    x *= rng.uniform(0.1, 20, size=(len(x), 1)).astype(np.float32)
    ids = np.arange(len(x)) * 3 + 1
    df = frame(spark, [(int(i), "m", 32, v.tolist(), 1) for i, v in zip(ids, x, strict=True)])
    got = N.nearest(df, **sizes).toPandas()
    want, _ = exact(x, ids)
    found = got.groupby("id")["other"].apply(set)
    assert set(found.index) == set(ids.tolist()) and (got.groupby("id").size() == 10).all()
    recall = sum(len(found[i] & w) for i, w in want.items()) / (10 * len(ids))
    assert recall >= 0.9
    at = {int(i): n for n, i in enumerate(ids)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in got.sample(200, random_state=1).itertuples():
        assert abs(r.cosine - float(u[at[r.id]] @ u[at[r.other]])) < 1e-5


@pytest.mark.parametrize("noise", [0.02, 0.05])
def test_recall_in_a_group_of_near_copies(spark, noise):
    """A third of the rows are near copies of one vector, many more than there are candidates."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    x = np.concatenate([base + noise * rng.normal(size=(3000, 64)), rng.normal(size=(6000, 64))]).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:300] @ u.T
    s[np.arange(300), np.arange(300)] = -2
    want = np.argsort(-s, axis=1)[:, :10]
    df = frame(spark, [(i, "m", 64, v.tolist(), 1) for i, v in enumerate(x)])
    found = N.nearest(df).filter("id < 300").toPandas().groupby("id")["other"].apply(set)
    assert sum(len(found[i] & set(w.tolist())) for i, w in enumerate(want)) / 3000 >= 0.95


@pytest.mark.parametrize("rows", [1, 5_000, 75_000, 10_000_000, 1_000_000_000, 1_000_000_000_000])
def test_leaves_grow_with_the_vectors_and_the_codebook_does_not(rows):
    sizes = N.level_sizes(rows, min(rows, 16_384), 4096)
    assert sum(sizes) <= 1024 + 3 * 256
    assert rows / np.prod(sizes) <= 1.5 * 4096


def test_levels():
    rng = np.random.default_rng(3)
    x = N._unit(rng.normal(size=(4000, 24)))
    book = N.fit(x, 400_000, leaf_rows=1000, first=16, further=5)
    assert [len(c) for c in book["levels"]] == [16, 5, 5] and N.leaf_count(book["levels"]) == 400
    leaf = N.home_leaf(book["levels"], x)
    assert leaf.min() >= 0 and leaf.max() < 400
    rest = np.linalg.norm(x - N.centre(book["levels"], leaf), axis=1).mean()
    assert rest < np.linalg.norm(x - book["levels"][0][leaf // 25], axis=1).mean()
    near = N.nearest_leaves(book["levels"], x[:300], 400)
    every = x[:300] @ N.centre(book["levels"], np.arange(400)).T
    assert (near == np.argsort(-every, axis=1, kind="stable")).mean() > 0.99 and all(len(set(r)) == 400 for r in near.tolist())


def test_what_counts(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", 2, [1.0, 0.0], 5), (1, "a", 2, [0.0, 1.0], 9), (1, "a", 2, [0.0, 1.0], 9),
        (2, "a", 2, [0.0, 30.0], 1), (3, "a", 2, None, 1), (4, "a", 2, [0.0, 0.0], 1), (5, "a", 2, [nan, 1.0], 1), (6, "a", 2, [inf, 1.0], 1),
        (7, "a", 2, [1.0, 1.0, 1.0], 1), (8, "b", 2, [0.0, 1.0], 1), (9, "a", 3, [0.0, 1.0, 0.0], 1), (10, "a", 3, [0.0, 2.0, 0.0], 1), (11, None, 2, [0.0, 1.0], 1), (None, "a", 2, [0.0, 1.0], 1),
        (12, "a", None, [0.0, 1.0], 1), (13, "a", 2, [None, 1.0], 1), (14, "a", 0, [], 1),
    ]
    got = {(r.id, r.other) for r in N.nearest(frame(spark, rows)).collect()}
    assert got == {(1, 2), (2, 1), (9, 10), (10, 9)}
    pairs = N.similar_pairs(N.nearest(frame(spark, rows))).collect()
    assert {(r.file_a, r.file_b) for r in pairs} == {(1, 2), (9, 10)}
    assert N.nearest(frame(spark, rows).limit(0)).count() == 0


def test_more_copies_than_places(spark):
    rows = [(i, "m", 4, [1.0, 2.0, 3.0, 4.0], 1) for i in range(40)] + [(100 + i, "m", 4, [4.0, -1.0 * i, 1.0, 0.5], 1) for i in range(20)]
    got = N.nearest(frame(spark, rows)).filter("id < 40").toPandas()
    assert (got.groupby("id").size() == 10).all() and (got["other"] < 40).all() and (got["cosine"] > 0.99999).all()


def test_score_aware_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(2)
    x = N._unit(rng.normal(size=(3000, 16)))
    plain = N._fit_centres(x, 1.0, 5, np.random.default_rng(1))
    aware = N._fit_centres(x, N.eta(16, 0.4), 5, np.random.default_rng(1))

    def parallel(centres, weight):
        codes = N.quantise(x, centres, weight)
        back = centres[np.arange(len(centres)), codes].reshape(len(x), -1)
        return float(np.mean(((x - back) * x).sum(1) ** 2))

    assert parallel(aware, N.eta(16, 0.4)) < parallel(plain, 1.0)


def test_table_scan_is_the_product_with_the_decoded_vector():
    rng = np.random.default_rng(4)
    x = N._unit(rng.normal(size=(50, 10)))
    padded = N._padded(x)
    centres = N._fit_centres(padded, 2.0, 3, rng)
    codes = N.quantise(padded, centres, 2.0)
    back = centres[np.arange(len(centres)), codes].reshape(len(x), -1)
    packed = codes[:, 0::2] << 4 | codes[:, 1::2]
    assert np.allclose(N.scan(x[:7], packed, centres), padded[:7] @ back.T, atol=1e-5)
