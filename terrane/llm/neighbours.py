"""Most similar vectors for every vector: anisotropic quantisation, four-bit table scans, exact reranking.

For each model a codebook is fitted on a bounded sample: leaves (k-means) and, for each pair of dimensions, sixteen
centres that minimise the score-aware loss, in which the part of the error that is parallel to the vector weighs
``eta`` times the rest. A model of more vectors than the leaves of one level can take has further levels: each cuts every
leaf by the same centres of what is left of its vectors, so the number of leaves grows with the number of vectors and the
codebook does not. Every vector is stored once, in its nearest leaf, as the length of its residual to the leaf's
centre and four bits a pair of dimensions of the residual's direction, and asks the leaves that the sample showed to be
enough. A leaf is cut into blocks of stored vectors and of queries, so a leaf that holds a third of all rows is many
tasks; in each, table scans pick candidates, whose exact cosines are returned. Where the codes' errors leave it open
whether another vector of the block is nearer, the query is compared with the whole block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.durable import written


_SPACE = "\x1f"
#: More than single precision may lose in a sum of products of unit vectors.
_ROUNDING = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _padded(x: np.ndarray) -> np.ndarray:
    """An even number of subspaces of two dimensions, so that two codes fill a byte."""
    extra = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, extra))) if extra else x


def eta(dimensions: int, threshold: float = 0.2) -> float:
    """Weight of the parallel residual for scores above ``threshold`` of the greatest."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


def centre(levels: list[np.ndarray], leaf: np.ndarray | int) -> np.ndarray:
    """Centres of leaves, the sums of one centre of each level. The number of a leaf holds a digit for each level, the last level's lowest."""
    out = 0.0
    for own in reversed(levels[1:]):
        out = out + own[leaf % len(own)]
        leaf = leaf // len(own)
    return levels[0][leaf] + out


def leaf_count(levels: list[np.ndarray]) -> int:
    return math.prod(map(len, levels))


def home_leaf(levels: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each unit vector, level by level."""
    leaf = (x @ levels[0].T).argmax(1)
    rest = x - levels[0][leaf] if len(levels) > 1 else x
    for own in levels[1:]:
        digit = (rest @ own.T - (own * own).sum(1) / 2).argmax(1)
        rest = rest - own[digit]
        leaf = leaf * len(own) + digit
    return leaf


#: Partial sums that are followed from one level to the next.
_BEAM = 128


def nearest_leaves(levels: list[np.ndarray], x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` leaves for each vector, the greatest inner product with their centres first."""
    if len(levels) > 1 and len(x) > 256:  # the sums of further levels are large
        return np.concatenate([nearest_leaves(levels, x[i : i + 256], most) for i in range(0, len(x), 256)])
    score = x @ levels[0].T
    leaf = np.broadcast_to(np.arange(len(levels[0])), score.shape)
    for own in levels[1:]:
        width = min(score.shape[1], max(_BEAM, math.ceil(4 * most / len(own))))
        kept = np.argpartition(-score, width - 1, axis=1)[:, :width]
        add = x @ own.T
        score = (np.take_along_axis(score, kept, axis=1)[:, :, None] + add[:, None, :]).reshape(len(x), -1)
        leaf = (np.take_along_axis(leaf, kept, axis=1)[:, :, None] * len(own) + np.arange(len(own))).reshape(len(x), -1)
    if most < score.shape[1]:
        kept = np.argpartition(-score, most - 1, axis=1)[:, :most]
        score, leaf = np.take_along_axis(score, kept, axis=1), np.take_along_axis(leaf, kept, axis=1)
    return np.take_along_axis(leaf, np.argsort(-score, axis=1, kind="stable"), axis=1)


def _residual(x: np.ndarray, levels: list[np.ndarray], home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direction (zero if there is none) and length of the way from each vector's leaf centre to it."""
    rest = x - centre(levels, home)
    length = np.linalg.norm(rest, axis=1)
    return rest / np.maximum(length, 1e-12)[:, None], length


def _decode(codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return centres[np.arange(len(centres)), codes].reshape(len(codes), -1)


def quantise(x: np.ndarray, centres: np.ndarray, weight: float, passes: int = 2, coded: np.ndarray | None = None) -> np.ndarray:
    """Codes (n, m) of ``coded`` (else of ``x``) by coordinate descent on the score-aware loss of the unit vectors ``x``; ``centres`` is (m, 16, 2)."""
    n, m = len(x), len(centres)
    parts = x.reshape(n, m, 2)
    goal = parts if coded is None else coded.reshape(n, m, 2)
    codes = np.empty((n, m), np.uint8)
    along = np.zeros((n, m), np.float32)
    for j in range(m):
        d = goal[:, j, None, :] - centres[j]
        codes[:, j] = (d * d).sum(2).argmin(1)
        along[:, j] = ((goal[:, j] - centres[j][codes[:, j]]) * parts[:, j]).sum(1)
    total = along.sum(1)
    for _ in range(passes):
        for j in range(m):
            d = goal[:, j, None, :] - centres[j]
            own = (d * parts[:, j, None, :]).sum(2)
            rest = (total - along[:, j])[:, None]
            best = ((d * d).sum(2) + (weight - 1) * (rest + own) ** 2).argmin(1)
            codes[:, j] = best
            now = own[np.arange(n), best]
            total += now - along[:, j]
            along[:, j] = now
    return codes


def _fit_centres(x: np.ndarray, weight: float, rounds: int, rng: np.random.Generator, coded: np.ndarray | None = None) -> np.ndarray:
    n, m = len(x), x.shape[1] // 2
    parts = x.reshape(n, m, 2)
    goal = parts if coded is None else coded.reshape(n, m, 2)
    centres = np.stack([goal[rng.choice(n, 16, replace=n < 16), j] + rng.normal(0, 1e-4, (16, 2)) for j in range(m)]).astype(np.float32)
    for _ in range(rounds):
        codes = quantise(x, centres, weight, 1, coded)
        chosen = centres[np.arange(m), codes]
        along = ((goal - chosen) * parts).sum(2)
        total = along.sum(1)
        for j in range(m):
            p, g = parts[:, j].astype(np.float64), goal[:, j].astype(np.float64)
            rest = total - along[:, j]
            outer = np.eye(2) + (weight - 1) * p[:, :, None] * p[:, None, :]
            target = g + (weight - 1) * (rest + (g * p).sum(1))[:, None] * p
            for c in range(16):
                own = codes[:, j] == c
                if own.any():
                    centres[j, c] = np.linalg.solve(outer[own].sum(0), target[own].sum(0))
    return centres


def _fit_leaves(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    leaves = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ leaves.T).argmax(1)
        for j in range(k):
            members = x[own == j]
            leaves[j] = members.sum(0) if len(members) else x[rng.integers(len(x))]
        leaves /= np.maximum(np.linalg.norm(leaves, axis=1, keepdims=True), 1e-12)
    return leaves


def _fit_rests(rest: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of what the levels so far leave of the vectors."""
    own = rest[rng.choice(len(rest), k, replace=False)].copy()
    for _ in range(rounds):
        near = (rest @ own.T - (own * own).sum(1) / 2).argmax(1)
        for j in range(k):
            members = rest[near == j]
            if len(members):
                own[j] = members.mean(0)
    return own


def level_sizes(rows: int, sample: int, leaf_rows: int, first: int = 1024, further: int = 256) -> list[int]:
    """How many centres each level has so that a leaf holds about ``leaf_rows`` of ``rows`` vectors."""
    most = max(1, sample // 16)
    wanted = max(1, round(rows / leaf_rows))
    sizes = [min(first, wanted, most)]
    while (missing := math.ceil(wanted / math.prod(sizes))) > 1 and most > 1:
        sizes.append(min(further, missing, most))
    return sizes


def _enough(x: np.ndarray, levels: list[np.ndarray], k: int, target: float) -> int:
    """How many nearest leaves hold the share ``target`` of the sample's true neighbours."""
    count = leaf_count(levels)
    if count == 1:
        return 1
    asked = x[: min(len(x), 1000 if len(levels) == 1 else 250)]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argpartition(-scores, min(k, len(x) - 2), axis=1)[:, :k]
    home = home_leaf(levels, x)
    found = nearest_leaves(levels, asked, min(count, 32_768))
    rank = np.full((len(asked), near.shape[1]), found.shape[1])
    for i in range(len(asked)):
        order = np.argsort(found[i])
        at = np.minimum(np.searchsorted(found[i], home[near[i]], sorter=order), found.shape[1] - 1)
        hit = found[i][order[at]] == home[near[i]]
        rank[i][hit] = order[at][hit]
    return int(min(found.shape[1], np.quantile(rank, target, method="higher") + 1))


def fit(x: np.ndarray, rows: int, k: int = 10, leaf_rows: int = 4096, target: float = 0.97, seed: int = 7, first: int = 1024, further: int = 256) -> dict:
    """Codebook of one model from a sample ``x`` of its ``rows`` unit vectors."""
    rng = np.random.default_rng(seed)
    sizes = level_sizes(rows, len(x), leaf_rows, first, further)
    levels = [_fit_leaves(x, sizes[0], rng)]
    for size in sizes[1:]:
        levels.append(_fit_rests(x - centre(levels, home_leaf(levels, x)), size, rng))
    way, _ = _residual(x, levels, home_leaf(levels, x))
    weight = eta(x.shape[1])
    return {
        "levels": levels,
        "centres": _fit_centres(_padded(x), weight, 6, rng, _padded(way)),
        "weight": weight,
        "probes": _enough(x, levels, k, target),
    }


def _rows(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """A matrix from a column of lists or of bytes, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Model, ids and unit vectors of the rows of each model in a batch of ``model, id, vector``."""
    models = batch.column("model")
    for model in models.unique().to_pylist():
        own = batch.filter(pc.equal(models, model))
        yield model, own.column("id").to_numpy(), _unit(_rows(own.column("vector"), np.float32))


_PLACED = "model string, leaf long, block int, part int, asks boolean, id long, vector binary, codes binary, length float, error float"


def _assign(shared, copies: dict):
    """Each vector once as stored, with its codes, and once for each leaf it asks."""
    names = [c.split()[0] for c in _PLACED.split(", ")]

    def rows(model, leaf, block, part, asks, ids, vectors, codes, length, error) -> pa.RecordBatch:
        n = len(ids)
        columns = [
            pa.array([model], pa.string()).take(pa.array(np.zeros(n, np.int64))),
            pa.array(leaf, pa.int64()),
            pa.array(np.broadcast_to(block, n), pa.int32()),
            pa.array(np.broadcast_to(part, n), pa.int32()),
            pa.array(np.full(n, asks)),
            pa.array(ids, pa.int64()),
            _bytes(vectors),
            pa.nulls(n, pa.binary()) if codes is None else _bytes(codes),
            pa.nulls(n, pa.float32()) if length is None else pa.array(length, pa.float32()),
            pa.nulls(n, pa.float32()) if error is None else pa.array(error, pa.float32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = {m: pickle.loads(b) for m, b in shared.value.items()}
        for batch in batches:
            for model, ids, x in _by_model(batch):
                book = books[model]
                near = nearest_leaves(book["levels"], x, book["probes"])
                home = home_leaf(book["levels"], x)
                way, length = _residual(x, book["levels"], home)
                codes = quantise(_padded(x), book["centres"], book["weight"], coded=_padded(way))
                error = length * np.linalg.norm(_padded(way) - _decode(codes, book["centres"]), axis=1)
                packed = codes[:, 0::2] << 4 | codes[:, 1::2]
                blocks, parts = copies[model]
                salt = (ids * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(33)
                block = (salt % blocks[home].astype(np.uint64)).astype(np.int32)
                for part in range(parts):
                    yield rows(model, home, block, part, False, ids, x, packed, length, error)
                part = ((salt >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
                for r in range(near.shape[1]):
                    for b in range(int(blocks[near[:, r]].max())):
                        asks = blocks[near[:, r]] > b
                        if asks.any():
                            yield rows(model, near[asks, r], b, part[asks], True, ids[asks], x[asks], None, None, None)

    return run


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate inner products (q, n): sums of table entries, one table of 256 for each byte of two codes."""
    q, m = len(queries), len(centres)
    tables = np.einsum("qmd,mcd->qmc", _padded(queries).reshape(q, m, 2), centres)
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(q, m // 2, 256)
    out = np.zeros((q, len(packed)), np.float32)
    for j in range(m // 2):
        out += pairs[:, j, :].astype(np.float32).take(packed[:, j], axis=1)
    return out


_FOUND = "model string, id long, other long, cosine double"


def _search(shared, k: int, candidates: int):
    def table(model, a, b, c) -> pa.Table:
        names = pa.array([model], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
        return pa.table({"model": names, "id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        model, leaf = key[0].as_py(), key[1].as_py()
        book = pickle.loads(shared.value[model])
        asks = rows.column("asks")
        stored, asking = rows.filter(pc.invert(asks)), rows.filter(asks)
        if not len(stored) or not len(asking):
            return table(model, [], [], [])
        data, ids = _rows(stored.column("vector"), np.float32), stored.column("id").to_numpy()
        packed = _rows(stored.column("codes"), np.uint8)
        queries, own = _rows(asking.column("vector"), np.float32), asking.column("id").to_numpy()
        length, error = stored.column("length").to_numpy(), stored.column("error").to_numpy()
        middle = centre(book["levels"], leaf)
        keep = min(candidates, len(data))
        found = []
        for at in range(0, len(queries), 256):
            q, me = queries[at : at + 256], own[at : at + 256]
            approximate = scan(q, packed, book["centres"]) * length
            picked = np.argpartition(-approximate, keep - 1, axis=1)[:, :keep]
            exact = np.einsum("qd,qnd->qn", q, data[picked], dtype=np.float32)
            exact[ids[picked] == me[:, None]] = -2  # not itself
            best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            cosine = np.take_along_axis(exact, best, axis=1)
            other = ids[np.take_along_axis(picked, best, axis=1)]
            if keep < len(data):
                # what any other vector may reach by its score and its code's error
                reach = approximate + error
                np.put_along_axis(reach, picked, -np.inf, axis=1)
                least = cosine[:, k - 1] if keep >= k else np.full(len(q), -2, np.float32)
                open_ = np.flatnonzero(reach.max(1) + q @ middle + _ROUNDING >= least)
                whole = q[open_] @ data.T
                whole[ids == me[open_, None]] = -2
                best = np.argpartition(-whole, min(k, len(data)) - 1, axis=1)[:, :k]
                if keep < k:
                    cosine, other = (np.pad(a, ((0, 0), (0, best.shape[1] - keep))) for a in (cosine, other))
                cosine[open_], other[open_] = np.take_along_axis(whole, best, axis=1), ids[best]
            real = cosine > -2
            found.append((np.repeat(me, real.sum(1)), other[real], cosine[real]))
        return table(model, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _sample(valid: DataFrame, rows: int) -> DataFrame:
    # row_number up to a constant is cut in each task before the shuffle
    order = Window.partitionBy("model").orderBy(F.xxhash64("id", F.lit("sample")))
    return valid.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows).drop("_r")


def valid_vectors(
    rows: DataFrame, id: str = "file_id", model: str = "model", vector: str = "vector", dimensions: str = "dimensions", version: str = "updated_at_ns"
) -> DataFrame:
    """``model, id, vector``: the latest row of each id and model, if its vector counts.

    Null, all zero and not finite vectors and those whose length isn't ``dimensions`` don't count, nor do rows with a
    null id or model. Of rows that tie on the version the one with the greater vector counts.
    """
    keyed = rows.select(F.col(id).cast("long").alias("id"), F.col(model).alias("model"), F.col(version).alias("version"), F.col(dimensions).alias("dimensions"), F.col(vector).alias("vector"))
    last = (
        keyed.filter("id IS NOT NULL AND model IS NOT NULL")
        .groupBy("model", "id")
        .agg(F.max(F.struct("version", "dimensions", "vector")).alias("r"))
        .select("model", "id", "r.dimensions", "r.vector")
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return last.filter((F.size("vector") == F.col("dimensions")) & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0)).drop("dimensions")


def nearest(
    rows: DataFrame,
    k: int = 10,
    candidates: int = 128,
    sample_rows: int = 16_384,
    leaf_rows: int = 4096,
    block_rows: int = 8192,
    part_rows: int = 16_384,
    centres: tuple[int, int] = (1024, 256),
    **columns: str,
) -> DataFrame:
    """``model, id, other, cosine``: for every valid vector up to ``k`` other vectors of its model, most similar first.

    The codebooks are fitted on at most ``sample_rows`` vectors of each model, and all vectors are indexed and ask. A leaf
    holds about ``leaf_rows`` vectors however many there are: the first level has up to ``centres[0]`` centres and each further one up to ``centres[1]``.
    ``candidates`` of each scanned block are reranked exactly, and a query to which another vector of the block may be
    as near is compared with all of it; so the cosines are exact, nothing is lost in a scanned block, and only the
    choice of leaves is approximate. Ties go to the lower id. See :func:`valid_vectors` for what counts (``columns`` are its column
    names). Models are not compared; a model with one valid vector gives no row; exact copies are each other's
    neighbours. The codebooks, at most a few hundred KB a model and independent of its size, are broadcast.
    """
    # vectors of one model but another length are as little comparable as those of another model
    space = F.concat_ws(_SPACE, "model", F.size("vector").cast("string"))
    valid = written(valid_vectors(rows, **columns).withColumn("model", space), "vectors")
    spark = rows.sparkSession
    sizes = {r["model"]: r["count"] for r in valid.groupBy("model").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "model string, id long, other long, cosine double")

    def fit_model(key: tuple, rows: pa.Table) -> pa.Table:
        model = key[0].as_py()
        x = _unit(_rows(rows.column("vector"), np.float32))
        book = fit(x, sizes[model], k, leaf_rows, first=centres[0], further=centres[1])
        return pa.table({"model": [model], "book": pa.array([pickle.dumps(book)], pa.binary())})

    books = {r["model"]: bytes(r["book"]) for r in _sample(valid, sample_rows).groupBy("model").applyInArrow(fit_model, "model string, book binary").collect()}
    shared = spark.sparkContext.broadcast(books)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = {m: pickle.loads(b)["levels"] for m, b in shared.value.items()}
        for batch in batches:
            for m, _, x in _by_model(batch):
                leaf, n = np.unique(home_leaf(levels[m], x), return_counts=True)
                yield pa.RecordBatch.from_pydict({"model": [m] * len(leaf), "leaf": leaf.astype(np.int64), "n": n.astype(np.int64)})

    copies = {}
    for m, b in books.items():
        book = pickle.loads(b)
        count = leaf_count(book["levels"])
        copies[m] = (np.ones(count, np.int64), max(1, math.ceil(sizes[m] * book["probes"] / count / part_rows)))
    # one small row a leaf, a few thousandths of the vectors: how many blocks each needs
    for r in valid.mapInArrow(home, "model string, leaf long, n long").groupBy("model", "leaf").agg(F.sum("n").alias("n")).collect():
        copies[r["model"]][0][r["leaf"]] = max(1, math.ceil(r["n"] / block_rows))
    placed = valid.mapInArrow(_assign(shared, copies), _PLACED)
    found = placed.groupBy("model", "leaf", "block", "part").applyInArrow(_search(shared, k, candidates), _FOUND)
    order = Window.partitionBy("model", "id").orderBy(F.col("cosine").desc(), F.col("other"))
    best = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return best.select(F.substring_index("model", _SPACE, 1).alias("model"), "id", "other", "cosine")


def similar_pairs(neighbours: DataFrame, least: float = 0.90) -> DataFrame:
    """``file_a < file_b, cosine``: pairs of which one is among the nearest of the other, with at least ``least``."""
    close = neighbours.filter(F.col("cosine") >= least)
    return close.groupBy(F.least("id", "other").alias("file_a"), F.greatest("id", "other").alias("file_b")).agg(F.max("cosine").alias("cosine"))
