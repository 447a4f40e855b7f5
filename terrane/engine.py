"""The engine over one index: build, incremental sync, search, queries and changes."""

from __future__ import annotations

import functools
import json
import os
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import journal as J
from terrane.durable import at_once, checkpointed, written
from terrane.errors import Closed, InvalidQuery, NotIndexed, UnsafePath
from terrane.functions.paths import ancestors, directory, within
from terrane.functions.text import segment_index, truncate_utf8
from terrane.functions.vectors import bucket, hash_vectors, model_name
from terrane.operators import context, graph, inverted, nearest, relational, retrieval
from terrane.operators.numbering import numbered
from terrane.plans import sqlfunctions, sqlgate
from terrane.snapshot import SCHEMA_VERSION, Store, Version
from terrane.sources import tree
from terrane.sources.extract import EXTRACT_BYTES, HEAD_BYTES, read_texts

#: Tables that are read by their name; the last three but one are made from ``chunk_concepts`` where they are read.
TABLES = ("files", "chunks", "symbols", "symbol_refs", "tags", "embeddings", "chunk_embeddings", "concepts", "concept_occurrences", "concept_edges", "scan_roots")
#: The column of file ids of each stored table; a table without one is written as a whole.
KEYS = {
    "files": "id",
    "file_postings": "id",
    "file_lengths": "id",
    **dict.fromkeys(("chunks", "symbols", "symbol_refs", "embeddings", "chunk_embeddings", "chunk_concepts", "chunk_postings"), "file_id"),
}
#: What is made from the row of a file, and thus anew when only the row changes.
_OF_FILES = ("files", "file_postings", "file_lengths")

_EMPTY = {
    "files": "id long, parent_id long, scan_root string, name string, path string, kind string, size long, mtime_ns long, link_target string, content_head string, content_hash string, mime string, tags_text string, search_text string, indexed_at_ns long",
    "file_postings": "token string, id long, field int, pos int",
    "file_lengths": "id long, length int",
    "chunks": "id long, file_id long, ordinal long, language string, symbol string, start_line long, end_line long, content string, content_hash string, search_text string",
    "chunk_postings": "token string, id long, field int, pos int, file_id long",
    "chunk_concepts": "chunk_id long, file_id long, pos int, name string, kind string",
    "symbols": "id long, file_id long, symbol string, kind string, start_line long, end_line long",
    "symbol_refs": "id long, file_id long, caller_symbol string, callee_symbol string, line long",
    "tags": "file_id long, tag string",
    "embeddings": "file_id long, model string, dimensions int, bucket int, vector array<float>, content_hash string, updated_at_ns long",
    "chunk_embeddings": "chunk_id long, model string, dimensions int, bucket int, vector array<float>, content_hash string, updated_at_ns long, file_id long",
    "scan_roots": "path string, last_scan_ns long, last_duration_ns long, entry_count long",
}


@dataclass(frozen=True)
class Options:
    """Settings of an engine."""

    content_bytes: int = HEAD_BYTES
    extract_bytes: int = EXTRACT_BYTES
    max_rows: int = sqlgate.MAX_ROWS
    #: A table of more parts than this is put together.
    most_parts: int = 8
    #: Folder of the journal of changes; by default beside the index, and needed where that isn't on a local file system.
    journal: str = ""
    dimensions: int = 256
    include: Sequence[str] = field(default=())
    exclude: Sequence[str] = field(default=())
    all_files: bool = False
    concept_fusion: bool = False
    #: Takes a DataFrame (id, text) and gives (id, vector); null is feature hashing.
    embedder: Callable[[DataFrame], DataFrame] | None = None
    embedder_name: str = ""
    reranker: Callable[[str, list[str]], list[float]] | None = None


@dataclass(frozen=True)
class ScanResult:
    root: str
    entries: int
    seconds: float


def _concept_id(name: Column) -> Column:
    """Concepts are known by a number that follows from their name, so it never changes."""
    return F.xxhash64(name).bitwiseAND(F.lit((1 << 63) - 1))


def _with_parents(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``rows`` with the id of the entry that holds each of them."""
    parents = every.select(F.col("id").alias("parent_id"), F.col("path").alias("_folder"))
    return rows.join(parents, directory(F.col("path")) == F.col("_folder"), "left").drop("_folder")


def _missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths that the file system doesn't have."""
    for batch in batches:
        yield batch.filter(pa.array([not os.path.lexists(p) for p in batch.column(0).to_pylist()], pa.bool_()))


class Engine:
    """An index at ``path``. Every change publishes a new version; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.local = "://" not in path
        self.spark, self.path, self.options = spark, os.path.abspath(path) if self.local else path.rstrip("/"), options or Options()
        tree.register(spark)
        self.store = Store(spark, self.path)
        self.store.current()  # refuses what a newer engine wrote
        folder = self.options.journal or (os.path.join(self.path, "journal") if self.local else "")
        self.journal = J.Journal(folder) if folder else None
        self._open = True
        sqlfunctions.register(spark)
        self.migrate()
        if self.journal is not None:
            J.recover(self.journal, self._rename_rows, self._remove_rows)

    # -- versions

    def migrate(self) -> bool:
        """Brings a version of an older schema up to date, step by step; each step is a version of its own."""
        version = self.store.current()
        if version is None or version.schema >= SCHEMA_VERSION:
            return False
        while version.schema < SCHEMA_VERSION:
            tables = self._STEPS.get(version.schema, lambda *_: {})(self, version)
            version = self.store.publish(tables, version, schema=version.schema + 1)
        return True

    def _add_search_text(self, version: Version) -> dict[str, DataFrame]:
        files = self.table("files", version).withColumn("search_text", segment_index(F.col("content_head")))
        return {"files": files, "chunks": self.table("chunks", version).withColumn("search_text", segment_index(F.col("content")))}

    def _add_concepts(self, version: Version) -> dict[str, DataFrame]:
        return {"chunk_concepts": self._concepts_of(self.table("chunks", version))}

    def _add_indexes(self, version: Version) -> dict[str, DataFrame]:
        files, chunks = self.table("files", version), self.table("chunks", version)
        vectors = self.table("chunk_embeddings", version).drop("file_id")
        with_file = vectors.join(chunks.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id")
        return {**self._index_of(files), "chunk_postings": self._postings_of(chunks), "chunk_concepts": self._concepts_of(chunks), "chunk_embeddings": with_file}

    #: By the schema that a step starts from.
    _STEPS = {1: _add_search_text, 2: _add_concepts, 3: _add_indexes}

    def columns(self, name: str) -> list[tuple[str, str]]:
        """Names and types of a table's columns."""
        return self.table(name).dtypes

    def close(self) -> None:
        self._open = False

    def _version(self) -> Version | None:
        if not self._open:
            raise Closed("the engine is closed")
        return self.store.current()

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        """A table of a version, empty if it was never written."""
        version = version or self._version()
        if name in ("concepts", "concept_occurrences", "concept_edges"):
            found = self.table("chunk_concepts", version).withColumn("concept_id", _concept_id(F.col("name")))
            if name == "concepts":
                return graph.concept_nodes(found).select(_concept_id(F.col("name")).alias("id"), "name", "kind", "doc_count")
            occurrences = found.select("concept_id", "chunk_id")
            return occurrences if name == "concept_occurrences" else graph.edges(occurrences)
        if version is None or name not in version.tables:
            return self.spark.createDataFrame([], _EMPTY[name])
        return self.store.read(name, version, KEYS.get(name))

    @property
    def model(self) -> str:
        return self.options.embedder_name or model_name(self.options.dimensions)

    def _embed(self, texts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``id, vector`` and the columns ``keep`` of ``texts`` (id, text and these)."""
        if self.options.embedder is None:
            return hash_vectors(texts, dimensions=self.options.dimensions, keep=keep)
        vectors = self.options.embedder(texts.select("id", "text"))
        return vectors.join(texts.select("id", *keep), "id") if keep else vectors

    # -- building

    def listing(self, root: str, paths: Sequence[str] | None = None) -> DataFrame:
        """The entries below a root, or those at and below some paths of it, that the policy admits."""
        options = {"root": root, "database": self.path, "all_files": str(self.options.all_files), "include": ",".join(self.options.include), "exclude": ",".join(self.options.exclude)}
        if paths is not None:
            options["paths"] = json.dumps(list(paths))
        return tree.entries(self.spark, options).filter(~within(F.col("path"), self.path))

    def scan(self, root: str, tags: Iterable[str] = (), skip_unchanged: bool = False) -> ScanResult:
        """Brings a subtree of the index to the state of the file system, in one new version.

        With ``skip_unchanged`` files with the same size and time and vectors of the current model are not read again.
        """
        began = time.time_ns()
        root = os.path.abspath(root)
        version = self._version()
        found = written(self.listing(root), "listing")
        entries = found.count()
        if not entries:
            raise NotIndexed(f"{root} doesn't exist")
        files = self.table("files", version)
        reuse = None
        if skip_unchanged and version is not None:
            reuse = relational.reusable(found, files, self.table("embeddings", version).withColumnRenamed("file_id", "file_id"), self.model).select("path")
        gone = relational.stale(files, root, found).select("path")
        self._apply(version, found, gone, root, began, list(tags), entries, reuse)
        return ScanResult(root, entries, (time.time_ns() - began) / 1e9)

    def sync(self, paths: Iterable[str], root: str | None = None, batch: int | None = None) -> int:
        """Brings single paths up to date; folders with everything below. A batch that was applied before is skipped."""
        version = self._version()
        if version is None:
            raise NotIndexed("nothing is indexed yet")
        paths = sorted({os.path.abspath(p) for p in paths})
        roots = [r["path"] for r in self.table("scan_roots", version).select("path").collect()]
        root = root or next((r for p in paths for r in sorted(roots, key=len, reverse=True) if p == r or p.startswith(r + "/")), None)
        if root is None:
            raise NotIndexed("no indexed folder holds these paths")
        if batch is not None and batch <= version.batches.get(root, -1):
            return 0
        found = written(self.listing(root, paths), "listing")
        known = self.table("files", version).select("path")
        # a known path is touched if it or a folder above it is given
        above = known.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
        given = self.spark.createDataFrame([(p,) for p in paths], "above string")
        gone = above.join(given, "above", "left_semi").select("path").distinct().join(found.select("path"), "path", "left_anti")
        self._apply(version, found, gone, root, time.time_ns(), [], None, None, {root: batch} if batch is not None else None)
        return len(paths)

    def _apply(self, version, found, gone, root, began, tags, entries, reuse, batches=None) -> None:
        """Publishes a version with the new rows of the entries that changed; all others' rows stay where they are."""
        files = self.table("files", version)
        changed = found if reuse is None else written(found.join(reuse, "path", "left_anti"), "changed")
        paths = files.select("path", "id")
        texts, ids = at_once(
            lambda: written(read_texts(changed, self.options.extract_bytes), "texts"),
            lambda: written(relational.with_ids(paths, changed.select("path")), "ids"),  # to paths alone, before any text is joined to them
        )
        mime = F.when(F.col("kind") == "dir", "inode/directory").when(F.col("kind") == "symlink", "inode/symlink").otherwise(F.coalesce("mime", F.lit("")))
        text = F.coalesce("text", F.lit(""))
        rows = changed.join(ids, "path").join(texts, "path", "left").select(
            "id",
            "path",
            F.lit(root).alias("scan_root"),
            "name",
            "kind",
            "size",
            "mtime_ns",
            "link_target",
            truncate_utf8(text, self.options.content_bytes).alias("content_head"),
            F.coalesce("content_hash", F.lit("")).alias("content_hash"),
            mime.alias("mime"),
            segment_index(truncate_utf8(text, self.options.content_bytes)).alias("search_text"),
            F.lit(began).alias("indexed_at_ns"),
        )
        rows = written(rows, "rows")
        dead = written(paths.join(gone, "path", "left_semi").join(rows.select("path"), "path", "left_anti").select(F.col("id").alias("file_id")), "dead")
        fresh = rows.select(F.col("id").alias("file_id"), "path")
        replaced = fresh.select("file_id").unionByName(dead)
        own = self.table("tags", version).join(dead, "file_id", "left_anti")
        top = paths.select(F.col("id").alias("file_id"), "path").unionByName(fresh).filter(F.col("path") == root).select("file_id").distinct()
        if tags:
            own = own.unionByName(top.select("file_id", F.explode(F.array(*map(F.lit, tags))).alias("tag"))).dropDuplicates()
        own = written(own, "tags")
        # rows of files that were not read again, but whose folder is new or whose tags changed
        folders = rows.filter("kind = 'dir'").join(paths.select("path"), "path", "left_anti").select("path")
        stay = files.join(replaced, F.col("id") == F.col("file_id"), "left_anti")
        orphans = stay.join(folders, directory(stay["path"]) == folders["path"], "left_semi")
        again = orphans if not tags else orphans.unionByName(stay.filter(F.col("path") == root)).dropDuplicates(["id"])
        every = paths.join(replaced, F.col("id") == F.col("file_id"), "left_anti").unionByName(rows.select("path", "id"))
        columns = self.spark.createDataFrame([], _EMPTY["files"]).columns
        plain = [c for c in columns if c not in ("parent_id", "tags_text")]
        now_files = written(self._with_tags(_with_parents(rows.select(*plain).unionByName(again.select(*plain)), every), own).select(*columns), "files")
        parsed = texts.join(fresh, "path")
        counters: dict[str, int] = {}
        added = {**self._index_of(now_files)}
        children = functools.partial(self._children, version=version, counters=counters, parsed=parsed)
        chunks, added["symbols"], added["symbol_refs"] = at_once(
            lambda: children("chunks", column="chunks", fields=["ordinal", "symbol", "start_line", "end_line", "content", "content_hash"], order=["ordinal"]),
            lambda: children("symbols", column="symbols", fields=["symbol", "start_line", "end_line"], order=["start_line", "symbol"]),
            lambda: children("symbol_refs", column="refs", fields=["caller", "callee", "line"], order=["line", "caller", "callee"]),
        )
        added["chunks"] = chunks
        added["chunk_postings"] = self._postings_of(chunks)
        added["chunk_concepts"] = self._concepts_of(chunks)
        now = F.lit(began)
        readable = now_files.filter("kind = 'file'").join(fresh.select(F.col("file_id").alias("id")), "id", "left_semi")
        added["embeddings"] = self._vector_rows(readable, retrieval.file_input(), "file_id", now)
        added["chunk_embeddings"] = self._vector_rows(chunks, retrieval.chunk_input(), "chunk_id", now, "file_id")
        tables = {"tags": own}
        if entries is not None:
            own_scan = self.spark.createDataFrame([(root, began, time.time_ns() - began, entries)], _EMPTY["scan_roots"])
            tables["scan_roots"] = self.table("scan_roots", version).filter(F.col("path") != root).unionByName(own_scan)
        gone_rows = {None: replaced, _OF_FILES: again.select(F.col("id").alias("file_id"))}
        self.compact(self.store.publish(tables, version, batches, added, gone_rows if version else None, counters))

    def compact(self, version: Version) -> Version:
        """Puts together the tables that have come to more parts than the options say."""
        many = [n for n, parts in version.tables.items() if len(parts) > self.options.most_parts]
        return self.store.publish({n: self.table(n, version) for n in many}, version) if many else version

    def _index_of(self, files: DataFrame) -> dict[str, DataFrame]:
        """Rows of files and what is made of each of them."""
        return {
            "files": files,
            "file_postings": inverted.in_token_order(inverted.postings(files, inverted.FILE_FIELDS)),
            "file_lengths": inverted.lengths(files, inverted.FILE_FIELDS),
        }

    @staticmethod
    def _postings_of(chunks: DataFrame) -> DataFrame:
        return inverted.in_token_order(inverted.postings(chunks, inverted.CHUNK_FIELDS, keep=["file_id"]))

    @staticmethod
    def _concepts_of(chunks: DataFrame) -> DataFrame:
        """Concepts of chunks, from which the graph is made, so that it never drifts from them."""
        return graph.extract_concepts(chunks, keep=["file_id"]).select("chunk_id", "file_id", F.col("pos").cast("int").alias("pos"), "name", "kind")

    def _children(self, name, version, counters, parsed, column, fields, order) -> DataFrame:
        """New rows of a table that belong to files, with new ids."""
        rows = parsed.select("file_id", "language", F.explode(column).alias("c")).select("file_id", "language", *(F.col(f"c.{f}").alias(f) for f in fields))
        if name == "chunks":
            rows = rows.withColumn("search_text", segment_index(F.col("content")))
        if name == "symbols":
            rows = rows.withColumn("kind", F.lit("function"))
        if name == "symbol_refs":
            rows = rows.withColumnRenamed("caller", "caller_symbol").withColumnRenamed("callee", "callee_symbol")
            order = [{"caller": "caller_symbol", "callee": "callee_symbol"}.get(o, o) for o in order]
        last = version.counters.get(name) if version else 0
        if last is None:  # a version of an older schema
            last = self.table(name, version).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        schema = self.spark.createDataFrame([], _EMPTY[name]).dtypes
        fresh = written(numbered(rows, ["file_id", *order], "id", last + 1).select(*(F.col(c).cast(t).alias(c) for c, t in schema)), name)
        counters[name] = fresh.agg(F.coalesce(F.max("id"), F.lit(last))).first()[0]
        return fresh

    @staticmethod
    def _with_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
        texts = relational.tags_text(tags).select(F.col("file_id").alias("id"), F.col("tags_text").alias("_t"))
        return files.drop("tags_text").join(texts, "id", "left").withColumn("tags_text", F.coalesce("_t", F.lit(""))).drop("_t")

    def _vector_rows(self, rows, text, key, now, *keep) -> DataFrame:
        vectors = self._embed(rows.select("id", text.alias("text"), "content_hash", *keep), ["content_hash", *keep])
        return vectors.select(
            F.col("id").alias(key), F.lit(self.model).alias("model"), F.size("vector").alias("dimensions"), bucket(F.col("vector")).alias("bucket"), F.col("vector").cast("array<float>").alias("vector"), "content_hash", now.alias("updated_at_ns"), *keep
        )

    # -- queries

    def list(self, path: str) -> DataFrame:
        return relational.ls(self.table("files"), os.path.abspath(path))

    def big(self, more_than: int) -> DataFrame:
        return relational.big(self.table("files"), more_than)

    def disk_usage(self, path: str) -> DataFrame:
        return relational.du(self.table("files"), os.path.abspath(path))

    def by_tag(self, tag: str) -> DataFrame:
        version = self._version()
        return relational.by_tag(self.table("files", version), self.table("tags", version), tag)

    def find(self, text: str) -> DataFrame:
        """Files with any of the words, by BM25 over the whole index."""
        version = self._version()
        files = self.table("files", version)
        asked = self._asked(text)
        if inverted.query_phrases(asked).isEmpty():
            raise InvalidQuery("nothing in the query can be searched for")
        index = inverted.Index(self.table("file_postings", version), self.table("file_lengths", version))
        hits = inverted.find(index, asked).join(files.select("id", "path", "kind", "size", "content_head"), "id")
        words = [r["token"] for r in inverted.query_phrases(asked).select("token").distinct().collect()]
        cut = inverted.snippets(words)
        top = hits.orderBy(F.desc(F.round("score", 9)), "path").limit(self.options.max_rows)
        return top.select("path", "kind", "size", "score", cut("content_head").alias("snippet")).orderBy(F.desc(F.round("score", 9)), "path")

    def related(self, name: str, limit: int = 20) -> DataFrame:
        version = self._version()
        names = self.spark.createDataFrame([(name,)], "name string")
        concepts = self.table("concepts", version)
        around = graph.edges_around(self.table("concept_occurrences", version), names.select(_concept_id(F.col("name")).alias("id")))
        return graph.related(names, concepts, around, concepts.select("id", "doc_count"), limit, directed=True)

    def concept_occurrences(self, name: str, limit: int = 20) -> DataFrame:
        version = self._version()
        names = self.spark.createDataFrame([(name,)], "name string")
        return graph.concept_occurrences(names, self.table("concepts", version), self.table("concept_occurrences", version), self.table("chunks", version), self.table("files", version), limit)

    def callers(self, symbol: str) -> DataFrame:
        return graph.callers(self.table("symbol_refs"), symbol)

    def callees(self, symbol: str) -> DataFrame:
        return graph.callees(self.table("symbol_refs"), symbol)

    def query(self, text: str, args=None, max_rows: int | None = None) -> sqlgate.Result:
        """Read-only SQL over the tables of the current version."""
        version = self._version()
        for name in TABLES:
            shown = self.table(name, version)
            (shown.drop("file_id") if name == "chunk_embeddings" else shown).createOrReplaceTempView(name)
        return sqlgate.query(self.spark, text, args, max_rows or self.options.max_rows)

    def _asked(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, text)], "query_id long, query_text string")

    def search_all(self, queries: DataFrame, request: retrieval.Request | None = None, now_ns: int | None = None) -> DataFrame:
        """Hybrid search for a table ``query_id, query_text``."""
        request = request or retrieval.Request()
        version = self._version()
        files, chunks = self.table("files", version), self.table("chunks", version)
        vectors = self._embed(queries.select(F.col("query_id").alias("id"), F.col("query_text").alias("text"))).withColumnRenamed("id", "query_id")
        limit = 4 * request.candidates
        own = self.table("embeddings", version).filter(F.col("model") == self.model)
        by_file = nearest.topk(own.select(F.col("file_id").alias("id"), "vector"), vectors, limit, limit)
        parts = self.table("chunk_embeddings", version).filter(F.col("model") == self.model)
        by_chunk = nearest.topk(parts.select(F.col("chunk_id").alias("id"), "vector"), vectors, limit, limit)
        near_chunks = retrieval.chunk_vectors(by_chunk, chunks)
        concepts = None
        if self.options.concept_fusion:
            concepts = retrieval.concept_neighbours(queries, self.table("concepts", version), None, self.table("concept_occurrences", version), chunks, request.candidates)
        return retrieval.hybrid_search(
            queries, files, chunks, request, now_ns or time.time_ns(), by_file, concepts, self.options.reranker,
            near_chunks=near_chunks, file_index=self.table("file_postings", version), chunk_index=self.table("chunk_postings", version),
        )

    def search(self, text: str, request: retrieval.Request | None = None, now_ns: int | None = None) -> DataFrame:
        return self.search_all(self._asked(text), request, now_ns).drop("query_id").orderBy("place")

    def context_pack(self, text: str, budget: int = 0, limit: int = 12, now_ns: int | None = None) -> DataFrame:
        version = self._version()
        hits = checkpointed(self.search_all(self._asked(text), retrieval.Request(limit=limit), now_ns))
        contents = context.hit_contents(hits, self.table("chunks", version), self.table("files", version))
        return context.context_pack(hits, contents, budget).drop("query_id").orderBy("place")

    def check(self) -> dict[str, int]:
        """Integrity counts, among them paths that are gone from the file system."""
        version = self._version()
        files = self.table("files", version)
        counts = relational.check(files, self.table("chunks", version), self.table("embeddings", version), self.table("concept_occurrences", version), self.table("concepts", version))
        out = {r["item"]: r["n"] for r in counts.collect()}
        out["missing_paths"] = files.select("path").mapInArrow(_missing, "path string").count()
        return out

    def rebuild(self) -> None:
        """Makes every derived column and table again, each in one part."""
        version = self._version()
        files = self.table("files", version).withColumn("search_text", segment_index(F.col("content_head")))
        files = written(self._with_tags(files, self.table("tags", version)), "files")
        chunks = written(self.table("chunks", version).withColumn("search_text", segment_index(F.col("content"))), "chunks")
        self.store.publish({**self._index_of(files), "chunks": chunks, "chunk_postings": self._postings_of(chunks), "chunk_concepts": self._concepts_of(chunks)}, version)

    # -- changes

    def _file_id(self, path: str, version: Version) -> int:
        row = self.table("files", version).filter(F.col("path") == path).select("id").first()
        if row is None:
            raise NotIndexed(path)
        return row["id"]

    def tag(self, path: str, tag: str) -> None:
        if not tag:
            raise ValueError("an empty tag")
        version = self._version()
        own = self.spark.createDataFrame([(self._file_id(os.path.abspath(path), version), tag)], _EMPTY["tags"])
        self._publish_tags(self.table("tags", version).unionByName(own).dropDuplicates(), version)

    def untag(self, path: str, tag: str) -> None:
        version = self._version()
        file_id = self._file_id(os.path.abspath(path), version)
        self._publish_tags(self.table("tags", version).filter(~((F.col("file_id") == file_id) & (F.col("tag") == tag))), version)

    def _publish_tags(self, tags: DataFrame, version: Version) -> None:
        tags = written(tags, "tags")
        # only files whose tags changed get new rows
        old = self.table("tags", version)
        touched = written(tags.exceptAll(old).unionByName(old.exceptAll(tags)).select("file_id").distinct(), "touched")
        rows = written(self._with_tags(self.table("files", version).join(touched.select(F.col("file_id").alias("id")), "id", "left_semi"), tags), "files")
        self.compact(self.store.publish({"tags": tags}, version, None, self._index_of(rows), {_OF_FILES: touched}))

    def _guard(self, path: str) -> str:
        if self.journal is None:
            raise UnsafePath("changes to files need the folder of a journal")
        path = os.path.abspath(path)
        if path == "/" or self.path == path or self.path.startswith(path.rstrip("/") + "/"):
            raise UnsafePath(path)
        return path

    def rename(self, old: str, new: str) -> None:
        """Moves a path and everything below it, in the file system and the index."""
        old, new = self._guard(old), self._guard(new)
        if os.path.lexists(new):
            raise FileExistsError(new)
        self._file_id(old, self._version())
        entry = self.journal.begin("rename", old, new)
        os.rename(old, new)
        entry = self.journal.advance(entry, "fs_applied")
        self._rename_rows(old, new)
        self.journal.advance(self.journal.advance(entry, "db_applied"), "done")

    def _rename_rows(self, old: str, new: str) -> None:
        version = self._version()
        if version is None:
            return
        files = self.table("files", version)
        columns = files.columns
        inside = relational.rename_subtree(files.filter(within(F.col("path"), old)), old, new)
        every = files.filter(~within(F.col("path"), old)).select("path", "id").unionByName(inside.select("path", "id"))
        rows = written(_with_parents(inside.drop("parent_id"), every).select(*columns), "moved")
        moved = F.when(within(F.col("path"), old), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path"))
        scans = {"scan_roots": self.table("scan_roots", version).withColumn("path", moved)}
        self.compact(self.store.publish(scans, version, None, self._index_of(rows), {_OF_FILES: rows.select(F.col("id").alias("file_id"))}))

    def remove(self, path: str, recursive: bool = False) -> None:
        """Deletes a path from the file system and the index; a folder that isn't empty needs ``recursive``."""
        path = self._guard(path)
        self._file_id(path, self._version())
        if os.path.isdir(path) and not os.path.islink(path) and os.listdir(path) and not recursive:
            raise OSError(f"{path} isn't empty")
        stage = J.tombstone(path)
        entry = self.journal.begin("remove", path, stage_path=stage)
        os.rename(path, stage)
        entry = self.journal.advance(entry, "fs_applied")
        self._remove_rows(path)
        entry = self.journal.advance(entry, "db_applied")
        J.delete(stage, path)
        self.journal.advance(entry, "done")

    def _remove_rows(self, path: str) -> None:
        version = self._version()
        if version is None:
            return
        gone = written(self.table("files", version).filter(within(F.col("path"), path)).select(F.col("id").alias("file_id")), "gone")
        tables = {
            "tags": self.table("tags", version).join(gone, "file_id", "left_anti"),
            "scan_roots": self.table("scan_roots", version).filter(~within(F.col("path"), path)),
        }
        self.store.publish(tables, version, replaced={None: gone})
