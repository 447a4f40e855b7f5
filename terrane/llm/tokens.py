"""Encoding a whole corpus with a byte-level BPE vocabulary, each distinct pre-token once.

Pre-tokens are independent of each other, and a corpus has far fewer distinct ones than occurrences. One pass over the
texts replaces every pre-token by its place in the word list of its block, a stretch of some thousand documents; the
order of these places is the order in the text. Only the word lists are shuffled by word: each distinct word of the
corpus is encoded once, its ids go back to the blocks that hold it, and each block is put together again by position.
A word in every document is thus sent once a block, not once an occurrence, and no key gathers the corpus.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.durable import written
from terrane.tables import spread

#: Where the public vocabularies lie; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLOCK = "block long, doc_id long, codes array<int>, place int, word string"


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=_ranks(data), special_tokens={})


def _lists(values: list[np.ndarray] | np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    flat = values if isinstance(values, np.ndarray) else np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, pa.int32()))


def _blocks(most_tokens: int, most_docs: int):
    """Documents as places in the word list of their block, and the word lists."""
    find = regex.compile(PATTERN).findall

    def flush(ids: list, codes: list[np.ndarray], words: dict[str, int]) -> pa.RecordBatch:
        d, w = len(ids), len(words)
        block = np.full(d + w, uuid.uuid4().int >> 65, np.int64)
        arrays = [
            pa.array(block),
            pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(w, pa.int64())]),
            pa.concat_arrays([_lists(codes, np.array([len(c) for c in codes], np.int64)), pa.nulls(w, pa.list_(pa.int32()))]),
            pa.concat_arrays([pa.nulls(d, pa.int32()), pa.array(np.arange(w, dtype=np.int32))]),
            pa.concat_arrays([pa.nulls(d, pa.string()), pa.array(list(words), pa.string())]),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["block", "doc_id", "codes", "place", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        codes: list[np.ndarray] = []
        words: dict[str, int] = {}
        tokens = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find(text) if text else []
                for w in set(found).difference(words):
                    words[w] = len(words)
                ids.append(doc)
                codes.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                tokens += len(found)
                if tokens >= most_tokens or len(ids) >= most_docs:
                    yield flush(ids, codes, words)
                    ids, codes, words, tokens = [], [], {}, 0
        if ids:
            yield flush(ids, codes, words)

    return run


def _encode_words(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column(0).to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(flat, sizes)], ["word", "ids"])

    return run


def _assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    """A block's documents, their places replaced by the ids of the words."""
    docs, words = docs.combine_chunks(), words.combine_chunks()
    place = words.column("place").to_numpy()
    ids = words.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    start[place], size[place] = offsets[:-1], np.diff(offsets)
    codes = docs.column("codes").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    ends = codes.offsets.to_numpy().astype(np.int64)
    code = codes.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    n = size[code]
    total = np.r_[0, np.cumsum(n)]
    out = flat[np.repeat(start[code] - total[:-1], n) + np.arange(total[-1])] if len(code) else np.empty(0, np.int32)
    sizes = np.diff(total[ends - ends[0]])
    return pa.table({"doc_id": docs.column("doc_id"), "ids": _lists(out.astype(np.int32), sizes)})


def encode_corpus(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    block_tokens: int = 2_000_000,
    block_docs: int = 20_000,
) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of the whole text, without special tokens.

    ``vocabulary`` is a rank file. Strings that look like special tokens are ordinary text. Null and empty texts give
    an empty list; repeated rows are each encoded; a null doc_id stays null; an empty table gives an empty result.
    Extra columns are never read. The vocabulary (about 1 MB, whatever the corpus) is broadcast.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = written(spread(rows).mapInArrow(_blocks(block_tokens, block_docs), _BLOCK), "pretokens")
    words = blocks.filter("word IS NOT NULL").select("block", "place", "word")
    encoded = words.select("word").distinct().mapInArrow(_encode_words(shared), "word string, ids array<int>")
    back = words.join(encoded, "word").select("block", "place", "ids")
    docs = blocks.filter("codes IS NOT NULL").select(F.col("block").alias("home"), "doc_id", "codes")
    return docs.groupBy("home").cogroup(back.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ids: each position joins the token-byte table, which has as many rows as the vocabulary.

    An empty list gives an empty text, a null list null; an id that isn't in the vocabulary gives no bytes. Needs
    doc_id to be unique.
    """
    spark = encoded.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = _ranks(f.read())
    table = spark.createDataFrame([(i, token.hex()) for token, i in ranks.items()], "id int, hex string")
    one = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    # the broadcast side is the vocabulary, of fixed size
    parts = one.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    texts = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    whole = F.decode(F.unhex(F.array_join("parts.hex", "")), "UTF-8")
    return one.join(texts, "doc_id", "left").select(
        "doc_id", F.when(F.col("ids").isNotNull(), F.coalesce(whole, F.lit(""))).alias("text")
    )
