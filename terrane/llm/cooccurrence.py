"""Items that appear together: pair counts by stripes, lift and log-likelihood ratio.

Each task turns its baskets into stripes, for an item the array of its partners and their counts, and merges equal
keys before anything is sent. What a task holds is bounded: pairs are expanded some at a time and added up, and the
sum is sent when it has grown to a limit. A basket of many items is cut into blocks of items, and each pair of blocks is
a row of its own that any task can take. The stripes of an item are cut by partner into ``shards``, so an item
that holds a third of all rows is merged by many tasks, and partners of different shards never meet. Merging reads
each shard as a sorted stream and holds one item's array at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.durable import written

#: Pairs that a task expands at once, and distinct ones that it adds up before it sends them.
_CHUNK, _HELD = 1_000_000, 2_000_000
_STRIPES = "item long, shard int, partners array<long>, counts array<long>"
_NONE = (np.empty(0, np.int64),) * 3


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (a, b) become one, their counts added; sorted by a, b."""
    if not len(a):
        return a, b, n
    small = min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 31
    order = np.argsort(a << 32 | b) if small else np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(n, first)


def _pairs(items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item i of each basket with itself and each later one; baskets are sorted."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    reach = ends - np.arange(len(items))
    left = np.repeat(np.arange(len(items)), reach)
    right = left + np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)
    return items[left], items[right]


def _cut(items: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of baskets with at most about ``_CHUNK`` pairs; a basket beyond that comes alone, in blocks of its rows."""
    start, at = 0, 0
    weight = np.cumsum(sizes * (sizes + 1) // 2)
    while start < len(sizes):
        done = weight[start - 1] if start else 0
        room = int(np.searchsorted(weight[start:] - done, _CHUNK, side="right"))
        if room == 0:
            own, k = items[at : at + sizes[start]], int(sizes[start])
            step = max(1, _CHUNK // k)
            for i in range(0, k, step):
                block = own[i : i + step]
                reach = k - np.arange(i, i + len(block))
                right = np.concatenate([own[j:] for j in range(i, i + len(block))])
                yield np.repeat(block, reach), right
            at += k
            start += 1
            continue
        run = sizes[start : start + room]
        n = int(run.sum())
        yield _pairs(items[at : at + n], run)
        at += n
        start += room


def _expanded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a batch: within ``items`` where ``others`` is null, else each of ``items`` with each of ``others``."""
    items, others = batch.column(0), batch.column(1)
    alone = items.filter(others.is_null())
    yield from _cut(alone.flatten().to_numpy(), np.diff(alone.offsets.to_numpy()))
    for i in np.flatnonzero(others.is_valid().to_numpy(zero_copy_only=False)).tolist():
        left, right = items[i].values.to_numpy(), others[i].values.to_numpy()
        step = max(1, _CHUNK // max(1, len(right)))
        for at in range(0, len(left), step):
            block = left[at : at + step]
            yield np.repeat(block, len(right)), np.tile(right, len(block))


def _striped(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int) -> pa.RecordBatch:
    a, b, n = pairs
    shard = (b % shards).astype(np.int32)
    order = np.lexsort((b, shard, a))
    a, b, n, shard = a[order], b[order], n[order], shard[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (shard[1:] != shard[:-1])])
    offsets = pa.array(np.r_[first, len(a)].astype(np.int32))
    arrays = [pa.array(a[first]), pa.array(shard[first]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n))]
    return pa.RecordBatch.from_arrays(arrays, ["item", "shard", "partners", "counts"])


def _stripes(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = _NONE, [], 0
        for batch in batches:
            for a, b in _expanded(batch):
                waiting.append((a, b, np.ones(len(a), np.int64)))
                size += len(a)
                if size >= _CHUNK:
                    held = _summed(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))
                    waiting, size = [], 0
                    if len(held[0]) >= _HELD:
                        yield _striped(held, shards)
                        held = _NONE
        held = _summed(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))
        if len(held[0]):
            yield _striped(held, shards)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up stripes that come sorted by item and shard; the last key of a batch waits for the next batch."""
    none = np.empty(0, np.int64)
    held = (none, none, none)
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        item, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        a = np.repeat(item, sizes)
        open_key = np.repeat((item == item[-1]) & (shard == shard[-1]), sizes)
        b, n = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        key = (item[-1], shard[-1])
        if last == key:
            ready, rest = ~open_key, open_key
            out = (a[ready], b[ready], n[ready])
            # the held key is the open one, so what is ready here came before it only if it is of another key
            held = _summed(*(np.concatenate((h, x[rest])) for h, x in zip(held, (a, b, n), strict=True)))
        else:
            ready = ~open_key
            out = tuple(np.concatenate((h, x[ready])) for h, x in zip(held, (a, b, n), strict=True))
            held = _summed(a[open_key], b[open_key], n[open_key])
        last = key
        out = _summed(*out)
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["item_a", "item_b", "n_ab"])
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["item_a", "item_b", "n_ab"])


def _term(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)


def _blocks_of(baskets: DataFrame, most: int) -> DataFrame:
    """``items, others``: each basket, or each pair of blocks of ``most`` items of a basket that has more."""
    small = baskets.filter(F.size("items") <= most).select("items", F.lit(None).cast("array<long>").alias("others"))
    count = F.ceil(F.size("items") / most).cast("int") - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), count), lambda i: F.transform(F.sequence(i, count), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cut = baskets.filter(F.size("items") > most).select("items", F.explode(pairs).alias("p"))
    block = lambda c: F.slice("items", F.col(c) * most + 1, most)
    large = cut.select(block("p.i").alias("items"), F.when(F.col("p.i") < F.col("p.j"), block("p.j")).alias("others"))
    return small.unionByName(large.repartition(F.xxhash64("items", "others")))


def basket_items(rows: DataFrame, item: str, basket: str) -> DataFrame:
    """``basket, items``: the sorted distinct items of each basket, gathered in each task before the shuffle."""
    return rows.groupBy(F.col(basket).alias("basket")).agg(F.sort_array(F.collect_set(F.col(item).cast("long"))).alias("items"))


def pair_counts(baskets: DataFrame, shards: int | None = None, block_items: int = 2048) -> DataFrame:
    """``item_a <= item_b, n_ab``: baskets that hold both; the rows with item_a = item_b count an item's baskets.

    ``baskets`` has a column ``items``, sorted and distinct. ``shards``, into how many parts an item's stripes are cut, is by default the number of shuffle partitions.
    """
    shards = shards or max(16, int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stripes = _blocks_of(baskets, block_items).mapInArrow(_stripes(shards), _STRIPES)
    merged = stripes.repartition("item", "shard").sortWithinPartitions("item", "shard")
    return merged.mapInArrow(_merge, "item_a long, item_b long, n_ab long")


def cooccurrence(
    occurrences: DataFrame,
    item: str = "concept_id",
    basket: str = "chunk_id",
    items: DataFrame | None = None,
    baskets: DataFrame | None = None,
    min_count: int = 5,
    min_llr: float = 3.84,
    shards: int | None = None,
) -> DataFrame:
    """``item_a < item_b, n_a, n_b, n_ab, n, lift, llr`` for every pair in at least ``min_count`` baskets.

    ``lift`` is n_ab * n / (n_a * n_b), how many times more often than chance the two occur together; ``llr`` is the
    log-likelihood ratio of the 2x2 table, and pairs under ``min_llr`` (3.84: 5 % by chi square) are left out, as are
    pairs that occur together less often than chance says.

    Rows with a null item or basket are ignored, and an item counts once in a basket. ``items`` and ``baskets`` (their
    ``id`` columns) restrict what counts; n is the number of baskets that are left with any item. Empty input gives
    an empty result. Extra columns are never read.
    """
    rows = occurrences.select(F.col(item).alias("item"), F.col(basket).alias("basket")).dropna()
    if items is not None:
        rows = rows.join(items.select(F.col("id").alias("item")).dropna().distinct(), "item", "left_semi")
    gathered = basket_items(rows, "item", "basket")
    if baskets is not None:  # after the rows are gathered: both sides lie by basket
        gathered = gathered.join(baskets.select(F.col("id").alias("basket")).dropna().distinct(), "basket", "left_semi")
    gathered = written(gathered.select("items"), "baskets")  # read twice: for n and for the pairs
    n = gathered.count()
    counts = written(pair_counts(gathered, shards).filter(F.col("n_ab") >= min_count), "pairs")
    single = counts.filter("item_a = item_b")
    pairs = (
        counts.filter("item_a < item_b")
        .join(single.select("item_a", F.col("n_ab").alias("n_a")), "item_a")
        .join(single.select("item_b", F.col("n_ab").alias("n_b")), "item_b")
        .withColumn("n", F.lit(n).cast("long"))
    )
    size = F.col("n").cast("double")
    both, a, b = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b"))
    only_a, only_b, neither = a - both, b - both, size - a - b + both
    llr = 2 * (
        _term(both, a * b / size)
        + _term(only_a, a * (size - b) / size)
        + _term(only_b, b * (size - a) / size)
        + _term(neither, (size - a) * (size - b) / size)
    )
    return (
        pairs.withColumn("lift", both * size / (a * b))
        .withColumn("llr", llr)
        .filter((F.col("lift") > 1) & (F.col("llr") >= min_llr))
        .select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", "lift", "llr")
    )
