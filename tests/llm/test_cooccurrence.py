import math
import random
from collections import Counter, defaultdict
from itertools import combinations

from terrane.llm.cooccurrence import basket_items, cooccurrence, pair_counts


def brute(rows, min_count=1):
    baskets = defaultdict(set)
    for item, basket in rows:
        if item is not None and basket is not None:
            baskets[basket].add(item)
    one, two = Counter(), Counter()
    for s in baskets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return len(baskets), one, {p: n for p, n in two.items() if n >= min_count}


def test_counts_against_brute_force_with_a_hot_item(spark):
    rng = random.Random(3)
    rows = [(1, b) for b in range(300)] + [(rng.randrange(2, 40), rng.randrange(300)) for _ in range(2000)]
    rows += rows[:100] + [(None, 1), (5, None), (None, None)]
    df = spark.createDataFrame(rows, "concept_id long, chunk_id long")
    n, one, two = brute(rows)
    got = cooccurrence(df, min_count=1, min_llr=0.0).collect()
    want = {p: c for p, c in two.items() if c * n > one[p[0]] * one[p[1]]}
    assert {(r.item_a, r.item_b): r.n_ab for r in got} == want
    for r in got:
        assert (r.n, r.n_a, r.n_b) == (n, one[r.item_a], one[r.item_b])
        assert math.isclose(r.lift, r.n_ab * n / (r.n_a * r.n_b))
        cells = [(r.n_ab, r.n_a * r.n_b / n), (r.n_a - r.n_ab, r.n_a * (n - r.n_b) / n), (r.n_b - r.n_ab, r.n_b * (n - r.n_a) / n)]
        cells.append((n - r.n_a - r.n_b + r.n_ab, (n - r.n_a) * (n - r.n_b) / n))
        assert math.isclose(r.llr, 2 * sum(o * math.log(o / e) for o, e in cells if o), abs_tol=1e-9)


def test_batches_and_shards_do_not_change_counts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.randrange(80)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "i long, b long")
    want = {(r.item_a, r.item_b, r.n_ab) for r in pair_counts(basket_items(df, "i", "b"), shards=1).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = [(r.item_a, r.item_b, r.n_ab) for r in pair_counts(basket_items(df, "i", "b"), shards=7).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(set(got)) and set(got) == want
    _, one, two = brute(rows)
    assert want == {(a, b, n) for (a, b), n in two.items()} | {(a, a, n) for a, n in one.items()}


def test_a_basket_of_more_pairs_than_are_expanded_at_once(spark, monkeypatch):
    import terrane.llm.cooccurrence as module

    monkeypatch.setattr(module, "_CHUNK", 50)
    import numpy as np

    items = np.arange(30, dtype=np.int64)
    got = [p for a, b in module._cut(np.r_[items, 1, 2], np.array([30, 2])) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(i, j) for i in range(30) for j in range(i, 30)] + [(1, 1), (1, 2), (2, 2)]
    assert sorted(got) == sorted(want)


def test_large_baskets_fall_into_pairs_of_blocks(spark, monkeypatch):
    import terrane.llm.cooccurrence as module

    monkeypatch.setattr(module, "_CHUNK", 40)
    monkeypatch.setattr(module, "_HELD", 60)
    rng = random.Random(8)
    rows = [(i, 0) for i in range(53)] + [(i, 1) for i in range(0, 53, 2)] + [(rng.randrange(60), rng.randrange(2, 30)) for _ in range(300)]
    df = spark.createDataFrame(rows, "i long, b long")
    got = [(r.item_a, r.item_b, r.n_ab) for r in pair_counts(basket_items(df, "i", "b"), shards=3, block_items=7).collect()]
    _, one, two = brute(rows)
    assert len(got) == len(set(got)) and set(got) == {(a, b, n) for (a, b), n in two.items()} | {(a, a, n) for a, n in one.items()}


def test_what_a_task_holds_is_bounded_by_its_limits_and_not_by_the_basket():
    import tracemalloc

    import pyarrow as pa

    import terrane.llm.cooccurrence as module

    run = module._stripes(16)
    peaks = []
    for k in (3_000, 6_000):
        batch = pa.RecordBatch.from_arrays([pa.array([list(range(k))], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int64()))], ["items", "others"])
        tracemalloc.start()
        n = sum(len(b.column(2).flatten()) for b in run(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == k * (k + 1) // 2
    assert peaks[1] < 1.5 * peaks[0] + 50_000_000


def test_counts_beyond_64_bits_when_multiplied(spark):
    from pyspark.sql import functions as F

    from terrane.llm.queries import strong_pairs

    rows = [(1, 2, 2_000_000_000, 2_000_000_000, 1_000_000_000, 6_000_000_000), (1, 3, 2_000_000_000, 2_000_000_000, 5_333_333_334, 6_000_000_000), (1, 4, 2_000_000_000, 2_000_000_000, 5_333_333_333, 6_000_000_000)]
    df = spark.createDataFrame(rows, "item_a long, item_b long, n_a long, n_b long, n_ab long, n long")
    assert [r.item_b for r in strong_pairs(df).select(F.col("item_b")).collect()] == [3]


def test_restriction_empty_tables_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (9, 1, "x"), (1, 2, "x"), (2, 2, "x"), (1, 7, "x"), (2, 7, "x"), (3, 3, "x")], "concept_id long, chunk_id long, id string")
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (None, "b")], "id long, chunk_id string")
    baskets = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    got = cooccurrence(rows, items=items, baskets=baskets, min_count=1, min_llr=0.0).collect()
    assert [(r.item_a, r.item_b, r.n_ab, r.n) for r in got] == [(1, 2, 2, 3)]
    assert cooccurrence(rows.limit(0)).count() == 0
    assert cooccurrence(rows, items=items.limit(0)).count() == 0
