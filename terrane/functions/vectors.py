"""Vectors: cosine, sign buckets and their probes as column expressions, and the feature-hashing embedder."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.text import analyze_terms

BITS = 8


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is empty or zero, or the lengths differ."""
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    product = norm(a) * norm(b)
    return F.when(comparable & (product > 0), dot(a, b) / product).otherwise(0.0)


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x / length).cast("float"))).otherwise(a)


def bucket(a: Column) -> Column:
    """The signs of the first eight components as bits; bit i is set if component i isn't negative."""
    bits = F.transform(F.slice(a, 1, BITS), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def probes(a: Column) -> Column:
    """The bucket and those that differ in one bit, the least certain component first; ties go to the lower one."""
    own = bucket(a)
    order = F.array_sort(F.transform(F.slice(a, 1, BITS), lambda x, i: F.struct(F.abs(x).alias("size"), i.alias("bit"))))
    return F.concat(F.array(own), F.transform(order, lambda s: own.bitwiseXOR(F.call_function("shiftleft", F.lit(1), s["bit"]))))


def fnv1a64(terms: list[str]) -> np.ndarray:
    """64-bit FNV-1a of each term's UTF-8 bytes, for all terms at once."""
    data = [t.encode() for t in terms]
    longest = max(map(len, data), default=0)
    out = np.full(len(data), 14695981039346656037, np.uint64)
    prime = np.uint64(1099511628211)
    padded = np.zeros((len(data), longest), np.uint8)
    sizes = np.array([len(x) for x in data])
    for i, x in enumerate(data):
        padded[i, : len(x)] = np.frombuffer(x, np.uint8)
    for j in range(longest):
        live = sizes > j
        out[live] = (out[live] ^ padded[live, j].astype(np.uint64)) * prime
    return out


@F.pandas_udf(T.StructType([T.StructField("hash", T.DecimalType(20, 0)), T.StructField("negative", T.BooleanType())]))
def _fnv(terms: pd.Series) -> pd.DataFrame:
    from decimal import Decimal

    h = fnv1a64(terms.tolist())
    return pd.DataFrame({"hash": [Decimal(int(x)) for x in h], "negative": (h >> np.uint64(63)) == 1})


def term_hash(term: Column) -> Column:
    """``hash`` (unsigned) and ``negative`` (its highest bit). Call it on distinct terms: it leaves the JVM."""
    return _fnv(term)


def hashes(terms: list[str]) -> np.ndarray:
    """:func:`fnv1a64` of terms of any lengths: those of like length are hashed together, so one long term doesn't make all of them long."""
    out = np.empty(len(terms), np.uint64)
    order = sorted(range(len(terms)), key=lambda i: len(terms[i]))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * len(terms[order[end]]) <= 1 << 20:
            end += 1
        out[order[begin:end]] = fnv1a64([terms[i] for i in order[begin:end]])
        begin = end
    return out


def unit_rows(terms: pa.ListArray, dimensions: int) -> np.ndarray:
    """Feature-hashed unit vectors of lists of terms, one a row; zero for an empty list."""
    offsets = np.asarray(terms.offsets)
    flat = terms.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    known = hashes(flat.dictionary.to_pylist())
    slot, sign = (known % np.uint64(dimensions)).astype(np.int64), np.where(known >> np.uint64(63) == 1, -1.0, 1.0)
    which = np.asarray(flat.indices)
    row = np.repeat(np.arange(len(terms)), np.diff(offsets))
    sums = np.bincount(row * dimensions + slot[which], sign[which], len(terms) * dimensions).astype(np.float64).reshape(-1, dimensions)
    length = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).astype(np.float32)


#: So many rows are made into vectors at once.
_ROWS = 2048


def hash_vectors(texts: DataFrame, id: str = "id", text: str = "text", dimensions: int = 256, keep: Sequence[str] = ()) -> DataFrame:
    """``id, vector`` and the columns ``keep``: feature-hashed unit vectors of texts.

    Each term adds 1 or -1 (by its hash's highest bit) to the component ``hash mod dimensions``. Every distinct term of
    a batch is hashed once, and nothing is shuffled. A text without terms has no direction: its vector is all zero. Null
    texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(begin, _ROWS)
                vectors = unit_rows(batch.column(1), dimensions)
                made = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, dimensions, np.int32), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), made, *batch.columns[2:]], names)

    source = texts.select(F.col(id).alias("id"), analyze_terms(F.col(text)).alias("terms"), *keep)
    names = ["id", "vector", *keep]
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"{n} {'array<float>' if n == 'vector' else kinds[n]}" for n in names))


@functools.cache
def model_name(dimensions: int) -> str:
    """Name under which vectors of :func:`hash_vectors` are stored."""
    if dimensions < 32:
        raise ValueError("a hash embedding needs at least 32 dimensions")
    return f"hash-v2-{dimensions}"


@F.pandas_udf(T.BinaryType())
def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(blobs: pd.Series, dimensions: pd.Series) -> pd.Series:
    def one(blob: bytes | None, n: int) -> np.ndarray | None:
        return np.frombuffer(blob, "<f4") if blob is not None and len(blob) == 4 * n else None

    return pd.Series([one(b, n) for b, n in zip(blobs, dimensions, strict=True)])


def encode_vector(a: Column) -> Column:
    """A vector as the bytes of its little-endian 32-bit floats, as other engines store it."""
    return _encode(a)


def decode_vector(blob: Column, dimensions: Column) -> Column:
    """The vector of such bytes; null if they don't make so many numbers."""
    return _decode(blob, dimensions)
