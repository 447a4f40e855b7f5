"""Queries on what is usually called and not asked: sources, engine, journal, versions, plug-ins, gate, serving, streams.

The tree of folders that an engine reads is made from the table ``files`` in the shared folder, once for each folder of
tables, so that all its rows pass through the source.
"""

from __future__ import annotations

import io
import json
import os
import threading
import time
import uuid
import zipfile
from collections.abc import Iterator
from types import SimpleNamespace
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import cli, journal, plugins
from terrane.durable import shared_dir, written
from terrane.engine import Engine, Options
from terrane.errors import EngineError
from terrane.functions.paths import validated
from terrane.functions.vectors import decode_vector, encode_vector
from terrane.operators import retrieval
from terrane.operators.nearest import capped_count
from terrane.operators.relational import current_files
from terrane.plans import sqlfunctions, sqlgate
from terrane.queries.common import CHUNKS, FILES, quoted, terms, tokens
from terrane.server import Service
from terrane.snapshot import Store
from terrane.sources.extract import extract_files
from terrane.sources.policy import Policy, is_index_artifact
from terrane.sources.tree import register
from terrane.streaming import windows
from terrane.tables import table

_MADE: dict[tuple, object] = {}
_LOCK = threading.RLock()  # one thing is made of another


def _once(spark: SparkSession, d: str, name: str, make):
    """What is made once for an application and a folder of tables in its present state."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/files.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, d, status.getModificationTime(), name)
    with _LOCK:
        if key not in _MADE:
            _MADE[key] = make()
        return _MADE[key]


def _folder(spark: SparkSession, name: str) -> str:
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:").rstrip("/")
    if "://" in shared:
        raise RuntimeError("a tree of folders needs a shared folder that is mounted")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _put(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, kind, target, content in zip(frame["path"], frame["kind"], frame["link_target"], frame["content_head"], strict=True):
                full = root + path
                if kind == "dir":
                    os.makedirs(full, exist_ok=True)
                    continue
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if kind == "symlink":
                    os.symlink(target or "nowhere", full)
                else:
                    with open(full, "wb") as f:
                        f.write((content or "").encode())
            yield frame[["path"]]

    return run


def _tree(spark: SparkSession, d: str, name: str) -> str:
    """A tree of all current files with their contents."""
    root = _folder(spark, name)
    rows = current_files(table(spark, d, "files"), ["path", "kind", "link_target", "content_head"]).select("path", "kind", "link_target", "content_head")
    rows.filter("path IS NOT NULL").mapInPandas(_put(root), "path string").count()
    return root


def _made_tree(spark: SparkSession, d: str) -> str:
    return _once(spark, d, "tree", lambda: _tree(spark, d, "tree"))


def _engine(spark: SparkSession, d: str) -> SimpleNamespace:
    """An engine that has scanned the tree; ``root`` is the tree."""

    def make():
        root = _made_tree(spark, d)
        engine = Engine(spark, f"{root}-index", Options(dimensions=32, all_files=True))
        engine.scan(root, tags=["project", "all"])
        return SimpleNamespace(engine=engine, root=root)

    return _once(spark, d, "engine", make)


def _changed(spark: SparkSession, d: str) -> SimpleNamespace:
    """An engine after a sync of single paths, tags, a rename and a removal."""

    def make():
        root = _tree(spark, d, "changing")
        engine = Engine(spark, f"{root}-index", Options(dimensions=32, all_files=True))
        engine.scan(root)
        files = current_files(table(spark, d, "files"), ["path", "kind"]).filter("kind = 'file'").select("id", "path")
        paths = {r["id"]: r["path"] for r in files.filter("id % 7 = 0 OR id % 11 = 0").collect()}  # the paths that the sync is told
        for number, path in paths.items():
            if number % 11 == 0:
                os.unlink(root + path)
            else:
                with open(root + path, "wb") as f:
                    f.write(b"changed zyzzogeton\n")
        told = [root + p for p in paths.values()]
        engine.sync([*told, *told[: len(told) // 2]], root, batch=1)
        again = engine.sync(told, root, batch=1)
        folders = sorted(f.name for f in os.scandir(f"{root}/srv/trees") if f.is_dir())
        engine.tag(f"{root}/srv/trees/{folders[0]}", "kept")
        engine.tag(f"{root}/srv/trees/{folders[0]}", "kept")
        engine.tag(f"{root}/srv/trees/{folders[1]}", "dropped")
        engine.untag(f"{root}/srv/trees/{folders[1]}", "dropped")
        engine.rename(f"{root}/srv/trees/{folders[0]}", f"{root}/srv/trees/{folders[0]}-moved")
        engine.remove(f"{root}/srv/trees/{folders[1]}", recursive=True)
        return SimpleNamespace(engine=engine, root=root, again=again)

    return _once(spark, d, "changed", make)


def _below(df: DataFrame, root: str, *columns) -> DataFrame:
    return df.select(F.substring("path", len(root) + 1, 1 << 20).alias("path"), *columns)


def tree_listing(spark, d):
    """What the source lists of the tree."""
    root = _made_tree(spark, d)
    register(spark)
    return _below(spark.read.format("tree").option("root", root).option("all_files", "true").load(), root, "kind", "size", "link_target")


def engine_files(spark, d):
    """The rows of files after a scan, with their folders."""
    e = _engine(spark, d)
    files = e.engine.table("files")
    parents = files.select(F.col("id").alias("parent_id"), F.substring("path", len(e.root) + 1, 1 << 20).alias("parent"))
    return _below(files.join(parents, "parent_id", "left"), e.root, "kind", "size", "parent", "content_head", "content_hash", "tags_text")


def engine_chunks_join(spark, d):
    """Chunks and vectors of the scanned files: how many there are of each, and none without its file."""
    e = _engine(spark, d).engine
    files = e.table("files").select("id", "kind")
    chunks = e.table("chunks").groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    vectors = e.table("embeddings").groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("vectors"))
    each = files.join(chunks, "id", "full").join(vectors, "id", "full")
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("chunks") > 0).cast("int")).alias("with_chunks"), F.sum("vectors").alias("vectors"))


def engine_changes(spark, d):
    """Paths and sizes after a sync, a rename and a removal."""
    c = _changed(spark, d)
    return _below(c.engine.table("files"), c.root, "kind", "size")


def engine_changed_words(spark, d):
    """Words of changed files are found, those of their former contents are gone from the index."""
    c = _changed(spark, d)
    postings = c.engine.table("file_postings").filter("token = 'zyzzogeton'").select("id").distinct()
    kept = c.engine.table("file_lengths").agg(F.count(F.lit(1)).alias("n"))
    return postings.agg(F.count(F.lit(1)).alias("n")).select(F.lit("changed").alias("item"), "n").unionByName(kept.select(F.lit("indexed").alias("item"), "n"))


def engine_tags(spark, d):
    c = _changed(spark, d)
    tags = c.engine.table("tags").join(c.engine.table("files").select(F.col("id").alias("file_id"), "path"), "file_id")
    return _below(tags, c.root, "tag")


def engine_check(spark, d):
    """Integrity after all changes; every count but that of the rows is 0."""
    c = _changed(spark, d)
    return spark.createDataFrame([(k, v) for k, v in c.engine.check().items() if k != "file_rows"], "item string, n long")


def journal_entries(spark, d):
    """What the journal says of the changes, and that a batch isn't applied twice."""
    c = _changed(spark, d)
    rows = [(x.operation, x.state) for x in c.engine.journal.entries()] + [("batch again", str(c.again))]
    return spark.createDataFrame(rows, "operation string, state string")


def journal_recovery(spark, d):
    """What recovery makes of an entry in each state, by what the file system shows."""
    base = _folder(spark, "journal")
    out = []
    for state in ("prepared", "fs_applied", "db_applied"):
        for old, new in ((True, False), (False, True), (True, True)):
            root = f"{base}/{state}-{old}-{new}"
            os.makedirs(root)
            log = journal.Journal(f"{root}/journal")
            entry = log.begin("rename", f"{root}/old", f"{root}/new")
            if state != "prepared":
                entry = log.advance(entry, "fs_applied")
            if state == "db_applied":
                entry = log.advance(entry, "db_applied")
            for there, name in ((old, "old"), (new, "new")):
                if there:
                    open(f"{root}/{name}", "w").close()
            calls: list[str] = []
            try:
                end = journal.recover(log, lambda a, b, calls=calls: calls.append("rename"), lambda a: None)[0].state
                again = len(journal.recover(log, lambda a, b: None, lambda a: None))
            except EngineError:
                end, again = "ambiguous", 0
            out.append((state, old, new, end, len(calls), again))
    names = [journal.tombstone(f"/a/b{i}") for i in range(3)]
    out += [("tombstone", len(set(names)) == 3, journal.is_tombstone_of(n, f"/a/b{i}"), "", 0, 0) for i, n in enumerate(names)]
    return spark.createDataFrame(out, "state string, old boolean, new boolean, outcome string, renamed int, again int")


def version_parts(spark, d):
    """All files through a store: a whole table, then a third of its rows replaced, then a part of them gone."""
    store = Store(spark, _folder(spark, "store"))
    files = current_files(table(spark, d, "files"), ["path", "size"]).select(F.col("id").alias("file_id"), "path", "size")
    one = store.publish({"files": files})
    third = files.filter("file_id % 3 = 0")
    two = store.publish({}, one, added={"files": third.withColumn("size", F.col("size") + 1)}, replaced={None: third})
    three = store.publish({}, two, replaced={("files",): files.filter("file_id % 5 = 0")})
    return store.read("files", three, "file_id")


def vector_codec(spark, d):
    """Vectors as bytes and back."""
    rows = table(spark, d, "file_embeddings").filter("file_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").select("file_id", "model", F.size("vector").alias("n"), encode_vector(F.col("vector")).alias("blob"))
    back = rows.select("file_id", "model", F.octet_length("blob").alias("bytes"), decode_vector(F.col("blob"), F.col("n")).alias("v"))
    return back.select("file_id", "model", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), 0.0).otherwise(x.cast("double"))), 4).alias("total")).distinct()


#: Statements, and whether the gate lets them through.
_STATEMENTS = (
    ("SELECT 1", True), ("select count(*) from range(7)", True), ("WITH a AS (SELECT 2 AS x) SELECT x FROM a", True), ("EXPLAIN SELECT 1", True),
    ("-- note\nSELECT ';' AS x; ", True), ("/* a; b */ SELECT \"a;b\" AS x", True), ("SELECT 1; SELECT 2", False), ("DROP TABLE files", False),
    ("INSERT INTO files VALUES (1)", False), ("CREATE TABLE x AS SELECT 1", False), ("WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", False),
    ("SET spark.x = 1", False), ("", False), ("-- nothing", False), ("SELECT 'open", False), ("DELETE FROM files", False), ("TRUNCATE TABLE files", False), ("SELEC 1", False),
)


def gate_decisions(spark, d):
    out = []
    for text, _ in _STATEMENTS:
        try:
            sqlgate.query(spark, text, max_rows=5)
            allowed = True
        except EngineError:
            allowed = False
        out.append((text, allowed))
    return spark.createDataFrame(out, "statement string, allowed boolean")


def gate_row_bound(spark, d):
    """Rows and the mark of more, for bounds around the size of a table; with parameters."""
    table(spark, d, "nation").createOrReplaceTempView("gate_nation")
    out = []
    for most in (1, 24, 25, 26, 1000):
        r = sqlgate.query(spark, "SELECT * FROM gate_nation WHERE n_nationkey >= :low", {"low": 0}, max_rows=most)
        out.append((most, len(r.rows), r.truncated))
    return spark.createDataFrame(out, "bound int, n int, truncated boolean")


def sql_functions(spark, d):
    """This engine's functions in SQL, over all chunks."""
    sqlfunctions.register(spark)
    table(spark, d, "chunks").dropDuplicates(["id"]).createOrReplaceTempView("fn_chunks")
    return spark.sql("SELECT id, size(analyze_terms(content)) AS n_terms, size(index_tokens(content)) AS n_tokens, fts_match(content, 'ledger vault') AS hit FROM fn_chunks")


def patterns_validated(spark, d):
    out = []
    for pattern in ("*.go", " a?.md ", "[ab]*", "a/b", "a\\b", "", "  ", "[a"):
        try:
            out.append((pattern, validated([pattern, pattern])[0]))
        except ValueError:
            out.append((pattern, None))
    return spark.createDataFrame(out, "pattern string, accepted string")


def index_artifacts(spark, d):
    """Paths beside every 50th file that would be the index's own, if it were an index."""
    files = current_files(table(spark, d, "files"), ["path"]).select("id", "path")
    made = files.select("id", F.explode(F.array(*(F.concat("path", F.lit(x)) for x in ("", "-wal", "-shm", "-journal", ".bak", "-walx")))).alias("path"))
    one = files.agg(F.min("path")).first()[0]
    return made.filter(is_index_artifact(F.col("path"), one))


def capped_counts(spark, d):
    rows = table(spark, d, "file_embeddings")
    return spark.createDataFrame([(n, capped_count(rows, n)) for n in (0, 1, 100, 10_000_000)], "most long, n long")


def _stub_embedding(texts):
    return [[float(len(t)), float(len(texts) <= 64), 1.0] for t in texts]


def embedder_batches(spark, d):
    """An embedder of a function on lists of texts; it never gets more than it may."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = plugins.batched(_stub_embedding, 3)(texts)
    return vectors.select("id", F.element_at("vector", 1).cast("long").alias("length"), (F.element_at("vector", 2) == 1).alias("in_bounds"))


class _Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def _stub_service(request, timeout):
    """A service that answers out of order."""
    texts = json.loads(request.data)["input"]
    data = [{"index": i, "embedding": [float(len(t.encode())), float(i)]} for i, t in enumerate(texts)]
    return _Answer(json.dumps({"data": data[::-1]}).encode())


def http_embedder(spark, d):
    """An embedder that asks a service, here one in the process."""
    embed = plugins.http_embedding("http://127.0.0.1/v1/embeddings", "m", opener=_stub_service)
    texts = table(spark, d, "chunks").dropDuplicates(["id"]).select("id", F.col("symbol").alias("text"))
    return plugins.batched(embed, 2)(texts).select("id", F.element_at("vector", 1).cast("long").alias("bytes"))


def embedding_inputs(spark, d):
    """What is embedded of files and of chunks."""
    files = current_files(table(spark, d, "files"), ["name", "path", "content_head"]).select(F.lit("file").alias("of"), "id", F.md5(retrieval.file_input()).alias("input"))
    chunks = table(spark, d, "chunks").dropDuplicates(["id"]).select(F.lit("chunk").alias("of"), "id", F.md5(retrieval.chunk_input()).alias("input"))
    return files.unionByName(chunks)


def _docx(texts: pd.Series) -> pd.Series:
    def one(text: str) -> bytes:
        body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/media/note.xml", "<x><t>not read</t></x>")
            z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
            z.writestr("word/header1.xml", '<w:hdr xmlns:w="urn:w"><w:p><w:r><w:t>Header</w:t></w:r></w:p></w:hdr>')
        return out.getvalue()

    return texts.map(one)


#: What XML can't hold, and what it changes.
_XML_OUT = r"[^\t\n\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def office_texts(spark, d):
    """Every chunk as a document of a text processor, and the text that comes out of it."""
    chunks = table(spark, d, "chunks").dropDuplicates(["id"]).filter("content IS NOT NULL AND id IS NOT NULL")
    clean = F.regexp_replace("content", _XML_OUT, "")
    files = chunks.select(F.concat(F.col("id").cast("string"), F.lit(".docx")).alias("path"), F.pandas_udf(_docx, "binary", F.PandasUDFType.SCALAR)(clean).alias("content"))
    return extract_files(files).select("path", F.md5(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.coalesce("error", F.lit("")).alias("error"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """``path, content``: for each nation and language a file with a function for each supplier, which calls another."""
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    forms = {
        "py": ("", "def f{0}(a):\n    b = g{0}(a)\n    return b\n\n", ""),
        "go": ("package a\n\n", "func f{0}(a int) int {{\n\tb := g{0}(a)\n\treturn b\n}}\n\n", ""),
        "js": ("", "function f{0}(a) {{\n  const b = g{0}(a);\n  return b;\n}}\n\n", ""),
        "java": ("class A {\n\n", "    int f{0}(int a) {{\n        int b = g{0}(a);\n        return b;\n    }}\n\n", "}\n"),
        "rs": ("", "fn f{0}(a: i32) -> i32 {{\n    let b = g{0}(a);\n    return b;\n}}\n\n", ""),
    }
    out = None
    for extension, (head, form, foot) in forms.items():
        before, between, after = form.replace("{{", "{").replace("}}", "}").split("{0}")
        one = F.concat(F.lit(before), F.col("s_suppkey").cast("string"), F.lit(between), F.col("s_suppkey").cast("string"), F.lit(after))
        files = rows.select("s_nationkey", "s_suppkey", one.alias("t")).groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "t"))).alias("p"))
        own = files.select(F.concat(F.col("s_nationkey").cast("string"), F.lit(f".{extension}")).alias("path"), F.encode(F.concat(F.lit(head), F.array_join("p.t", ""), F.lit(foot)), "UTF-8").alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


def source_symbols(spark, d):
    """Functions of sources in five languages, with their lines."""
    return extract_files(_sources(spark, d)).select("path", F.explode("symbols").alias("s")).select("path", "s.symbol", "s.start_line", "s.end_line")


def source_calls(spark, d):
    """Who calls whom, and where."""
    return extract_files(_sources(spark, d)).select("path", F.explode("refs").alias("r")).select("path", "r.caller", "r.callee", "r.line")


def source_chunks(spark, d):
    """Chunks along the declarations: of Java and the like the methods, of Go also the package."""
    found = extract_files(_sources(spark, d)).select("path", "language", F.explode("chunks").alias("c"))
    return found.filter("c.symbol LIKE 'f%'").select("path", "language", "c.symbol", "c.start_line", "c.end_line")


def tree_change_events(spark, d):
    """A stream over a tree: everything as created, then what was changed and what was removed."""
    root = _tree(spark, d, "watched")
    register(spark)
    sink = _folder(spark, "events")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("path", "event", "kind").write.mode("append").parquet(sink)

    source = spark.readStream.format("tree_changes").option("root", root).option("all_files", "true").load()
    query = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{sink}-state").start()
    try:
        query.processAllAvailable()
        files = current_files(table(spark, d, "files"), ["path", "kind"]).filter("kind = 'file' AND id % 10 < 2").select("id", "path")
        for r in files.toLocalIterator():
            if not os.path.exists(root + r["path"]):
                continue
            if r["id"] % 10 == 0:
                os.unlink(root + r["path"])
            else:
                with open(root + r["path"], "ab") as f:
                    f.write(b"more\n")
        os.makedirs(f"{root}/new/folder")
        with open(f"{root}/new/folder/a.md", "w") as f:
            f.write("new")
        time.sleep(0.2)
        query.processAllAvailable()
    finally:
        query.stop()
    events = spark.read.parquet(sink)
    return _below(events.filter("NOT (kind = 'dir' AND event = 'write')"), root, "event", "kind")


def stream_windows(spark, d):
    """Events as a stream, applied batch by batch; the last state of each window counts."""
    events = table(spark, d, "events")
    sink = _folder(spark, "windows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = windows.tumbling(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(sink).withColumn("total", F.round("total", 4))


#: Messages to the serving layer, and the code of the answer (0: a result, null: no answer).
_MESSAGES = (
    ('{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}', 0), ('{"jsonrpc": "2.0", "method": "notifications/initialized"}', None), ('{"jsonrpc": "2.0", "id": 2, "method": "server/discover"}', 0),
    ('{"jsonrpc": "2.0", "id": 3, "method": "tools/list", "extra": 1}', 0), ('{"jsonrpc": "1.0", "id": 4, "method": "tools/list"}', -32600), ("[]", -32600), ('{"jsonrpc": "2.0", "id": 5, "method": "none"}', -32601),
    ('{"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "none"}}', -32602), ('{"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "search", "arguments": {"query": 5}}}', -32602),
    ('{"jsonrpc": "2.0", "id": 8, "method": "tools/call", "params": {"name": "search", "arguments": {"unknown": "x"}}}', -32602), ('{"jsonrpc": "2.0", "id": 9, "method": "tools/call", "params": {"name": "search", "arguments": {"min_size": 3}}}', -32000),
)


def rpc_codes(spark, d):
    service = Service(_engine(spark, d).engine)
    out = []
    for text, _ in _MESSAGES:
        answer = service.rpc(json.loads(text))
        out.append((text, None if answer is None else answer.get("error", {}).get("code", 0)))
    return spark.createDataFrame(out, "message string, code int")


def rest_requests(spark, d):
    """Requests to the handler on the loopback address: their status, and what is counted of them."""
    import urllib.error
    import urllib.request

    from terrane.server import make_server

    server = make_server(_engine(spark, d).engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path: str, body: bytes | None = None) -> tuple[int, dict]:
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body), timeout=600) as r:
                return r.status, json.loads(r.read() or b"{}")
        except urllib.error.HTTPError as e:
            return e.code, {}

    try:
        asked = [("/healthz", None), ("/none", None), ("/v1/search", b'{"unknown": 1}'), ("/v1/search", b"{"), ("/v1/search", b'{"min_size": 5}'), ("/v1/none", b"{}"), ("/v1/search", b'{"kinds": ["symlink"], "limit": 3}')]
        out = [(i, path, *(lambda s, v: (s, len(v.get("hits", []))))(*ask(path, body))) for i, (path, body) in enumerate(asked)]
        health = ask("/healthz")[1]
    finally:
        server.shutdown()
        server.server_close()
    out += [(len(asked), "requests", health["requests"], 0), (len(asked) + 1, "errors", health["errors"], 0)]
    return spark.createDataFrame(out, "place int, request string, status int, hits int")


def cli_outputs(spark, d):
    """Commands of the command line over the engine: each value of their JSON."""
    e = _engine(spark, d)
    trees = f"{e.root}/srv/trees"
    out = []
    for name, *arguments in (("ls", trees), ("du", trees), ("du", e.root), ("big", "0.00390625"), ("by-tag", "all"), ("query", "SELECT kind, count(*) AS n FROM files GROUP BY kind ORDER BY kind"), ("doctor",)):
        parsed = cli.parser().parse_args(["--index", e.engine.path, name, *arguments])
        value = json.loads(cli.to_json(cli.run(e.engine, parsed)))
        command = " ".join([name, *(a.replace(e.root, "") for a in arguments)]).strip()
        if name == "ls":
            out += [(command, r["name"], r["kind"]) for r in value]
        elif name == "big":
            out += [(command, r["path"].replace(e.root, ""), str(r["size"])) for r in value]
        elif name == "by-tag":
            out += [(command, r["path"].replace(e.root, ""), r["kind"]) for r in value]
        elif name == "query":
            out += [(command, str(k), str(n)) for k, n in value["rows"]] + [(command, "truncated", str(value["truncated"]))]
        elif name == "doctor":
            out += [(command, k, str(n)) for k, n in value.items()]
        else:
            out += [(command, k, str(n)) for k, n in value[0].items()]
    return spark.createDataFrame(out, "command string, item string, value string")


_DENIED = Policy().excluded_components
#: The tree that is made of the files, as the source must list it.
_TREE = f"""{FILES}, src AS (SELECT id, path, kind, coalesce(nullif(link_target, ''), 'nowhere') AS target, CASE WHEN contains(coalesce(content_head, ''), chr(0)) THEN '' ELSE coalesce(content_head, '') END AS text, octet_length(encode(coalesce(content_head, ''))) AS bytes FROM cur WHERE path IS NOT NULL),
    up AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM src, unnest(range(1, len(string_split(path, '/')))) AS t(n)),
    al AS (SELECT path, kind, target, text, bytes, id FROM src WHERE kind IN ('file', 'symlink') UNION ALL SELECT DISTINCT path, 'dir', '', '', 0, NULL FROM (SELECT path FROM up UNION SELECT path FROM src WHERE kind = 'dir')),
    tree AS (SELECT path, kind, CASE kind WHEN 'file' THEN bytes WHEN 'symlink' THEN octet_length(encode(target)) ELSE 0 END AS size, CASE WHEN kind = 'symlink' THEN target ELSE '' END AS link_target, text, id
      FROM al WHERE len(list_filter(string_split(path, '/')[2:], lambda x: regexp_matches(x, '{_DENIED}'))) = 0)"""
_NOW = f"""{_TREE}, tops AS (SELECT string_split(path, '/')[4] AS top, row_number() OVER (ORDER BY string_split(path, '/')[4]) AS n FROM (SELECT DISTINCT path FROM al WHERE kind = 'dir' AND len(string_split(path, '/')) = 4 AND starts_with(path, '/srv/trees/'))),
    one AS (SELECT '/srv/trees/' || top AS p FROM tops WHERE n = 1), two AS (SELECT '/srv/trees/' || top AS p FROM tops WHERE n = 2),
    live AS (SELECT path, kind, id, CASE WHEN kind = 'file' AND id % 7 = 0 THEN octet_length(encode('changed zyzzogeton' || chr(10))) ELSE size END AS size FROM tree WHERE NOT (kind = 'file' AND id % 11 = 0) AND NOT (path = (SELECT p FROM two) OR starts_with(path, (SELECT p FROM two) || '/'))),
    now_ AS (SELECT CASE WHEN path = (SELECT p FROM one) OR starts_with(path, (SELECT p FROM one) || '/') THEN (SELECT p FROM one) || '-moved' || substr(path, length((SELECT p FROM one)) + 1) ELSE path END AS path, kind, size, id FROM live)"""
_LIST = ", ".join


def _values(rows, columns: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"SELECT * FROM (VALUES {_LIST('(' + _LIST(map(one, r)) + ')' for r in rows)}) AS t({columns})"


_LANGUAGES = {"py": "python", "go": "go", "js": "javascript", "java": "java", "rs": "rust"}
#: Lines before the first function, and of each function with the blank line after it.
_LINES = {"py": (0, 4), "go": (2, 5), "js": (0, 5), "java": (2, 5), "rs": (0, 5)}
_FUNCTIONS = f"""fs AS (SELECT s_nationkey || '.' || e AS path, lang, 'f' || s_suppkey AS f, 'g' || s_suppkey AS g, head + each_ * (row_number() OVER (PARTITION BY s_nationkey, e ORDER BY s_suppkey) - 1) + 1 AS line, each_ - 2 AS more
    FROM supplier CROSS JOIN (VALUES {_LIST(f"('{e}', '{_LANGUAGES[e]}', {a}, {b})" for e, (a, b) in _LINES.items())}) AS l(e, lang, head, each_))"""

QUERIES = {f.__name__: f for f in (
    tree_listing, engine_files, engine_chunks_join, engine_changes, engine_changed_words, engine_tags, engine_check, journal_entries, journal_recovery, version_parts, vector_codec,
    gate_decisions, gate_row_bound, sql_functions, patterns_validated, index_artifacts, capped_counts, embedder_batches, http_embedder, embedding_inputs, office_texts,
    source_symbols, source_calls, source_chunks, tree_change_events, stream_windows, rpc_codes, rest_requests, cli_outputs,
)}
SQL = {
    "tree_listing": f"WITH {_TREE} SELECT path, kind, size, link_target FROM tree",
    "engine_files": f"""WITH {_TREE} SELECT path, kind, size, CASE WHEN path = '' THEN NULL ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
        CASE WHEN kind = 'file' THEN text ELSE '' END AS content_head, CASE WHEN kind = 'file' THEN sha256(text) ELSE '' END AS content_hash, CASE WHEN path = '' THEN 'all project' ELSE '' END AS tags_text FROM tree""",
    "engine_chunks_join": f"WITH {_TREE} SELECT kind, count(*) AS n, CASE WHEN kind = 'file' THEN sum(CASE WHEN regexp_matches(text, '[^\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}]') THEN 1 ELSE 0 END)::BIGINT END AS with_chunks, CASE WHEN kind = 'file' THEN count(*) END AS vectors FROM tree GROUP BY kind",
    "engine_changes": f"WITH {_NOW} SELECT path, kind, size FROM now_",
    "engine_changed_words": f"WITH {_NOW} SELECT 'changed' AS item, count(*) AS n FROM now_ WHERE kind = 'file' AND id % 7 = 0 UNION ALL SELECT 'indexed', count(*) FROM now_",
    "engine_tags": f"WITH {_NOW} SELECT p || '-moved' AS path, 'kept' AS tag FROM one",
    "engine_check": _values([(n, 0) for n in ("repeated_paths", "missing_parents", "chunks_without_file", "vectors_without_file", "occurrences_without_chunk", "occurrences_without_concept", "missing_paths")], "item, n"),
    "journal_entries": _values([("rename", "done"), ("remove", "done"), ("batch again", "0")], "operation, state"),
    "journal_recovery": _values(
        [
            ("prepared", True, False, "rolled_back", 0, 0), ("prepared", False, True, "done", 1, 0), ("prepared", True, True, "ambiguous", 0, 0),
            ("fs_applied", True, False, "ambiguous", 0, 0), ("fs_applied", False, True, "done", 1, 0), ("fs_applied", True, True, "ambiguous", 0, 0),
            ("db_applied", True, False, "done", 0, 0), ("db_applied", False, True, "done", 0, 0), ("db_applied", True, True, "done", 0, 0),
            *[("tombstone", True, True, "", 0, 0)] * 3,
        ],
        '"state", "old", "new", outcome, renamed, again',
    ),
    "version_parts": f"WITH {FILES} SELECT id AS file_id, path, CASE WHEN id % 3 = 0 THEN size + 1 ELSE size END AS size FROM cur WHERE id % 5 <> 0",
    "vector_codec": """SELECT DISTINCT file_id, model, 4 * len(vector) AS bytes, round(list_sum(list_transform(vector, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x::DOUBLE END)), 4) AS total
        FROM file_embeddings WHERE file_id IS NOT NULL AND vector IS NOT NULL AND len(vector) > 0""",
    "gate_decisions": _values(_STATEMENTS, "statement, allowed"),
    "gate_row_bound": "SELECT b AS bound, least(b, n)::INT AS n, b < n AS truncated FROM (SELECT unnest([1, 24, 25, 26, 1000]) AS b), (SELECT count(*) AS n FROM nation)",
    "sql_functions": f"WITH {CHUNKS} SELECT id, len({terms('content')}) AS n_terms, len({tokens('content')}) AS n_tokens, len(list_filter({tokens('content')}, lambda t: t IN ('ledger', 'vault'))) > 0 AS hit FROM ch",
    "patterns_validated": _values([("*.go", "*.go"), (" a?.md ", "a?.md"), ("[ab]*", "[ab]*"), ("a/b", None), ("a\\b", None), ("", None), ("  ", None), ("[a", None)], "pattern, accepted"),
    "index_artifacts": f"WITH {FILES}, one AS (SELECT min(path) AS p FROM cur), made AS (SELECT id, path || x AS path FROM cur, (SELECT unnest(['', '-wal', '-shm', '-journal', '.bak', '-walx']) AS x)) SELECT id, path FROM made, one WHERE path IN (p, p || '-wal', p || '-shm', p || '-journal')",
    "capped_counts": "SELECT m AS most, least(m + 1, n) AS n FROM (SELECT unnest([0, 1, 100, 10000000]) AS m), (SELECT count(*) AS n FROM file_embeddings)",
    "embedder_batches": "SELECT doc_id AS id, length(coalesce(text, '')) AS length, true AS in_bounds FROM documents",
    "http_embedder": f"WITH {CHUNKS} SELECT id, octet_length(encode(coalesce(symbol, ''))) AS bytes FROM ch",
    "embedding_inputs": f"""WITH {FILES}, {CHUNKS} SELECT 'file' AS "of", id, md5(concat_ws(chr(10), name, path, content_head)) AS input FROM cur UNION ALL SELECT 'chunk', id, md5(concat_ws(chr(10), symbol, content)) FROM ch""",
    "office_texts": f"""WITH {CHUNKS}, t AS (SELECT id, regexp_replace(content, '{_XML_OUT}', '', 'g') AS c FROM ch WHERE content IS NOT NULL AND id IS NOT NULL),
        p AS (SELECT id, array_to_string(list_transform(string_split(c, chr(10)), lambda l: CASE WHEN l = '' THEN '' ELSE l || ' ' END || chr(10)), '') || chr(10) || 'Header' AS text FROM t)
        SELECT id || '.docx' AS path, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+', ' ', 'g')) AS text, '' AS error FROM p""",
    "source_symbols": f"WITH {_FUNCTIONS} SELECT path, f AS symbol, line AS start_line, line + more AS end_line FROM fs",
    "source_calls": f"WITH {_FUNCTIONS} SELECT path, f AS caller, g AS callee, line + 1 AS line FROM fs",
    "source_chunks": f"WITH {_FUNCTIONS} SELECT path, lang AS language, f AS symbol, line AS start_line, line + more AS end_line FROM fs",
    "tree_change_events": f"""WITH {_TREE} SELECT path, 'create' AS event, kind FROM tree UNION ALL SELECT path, CASE WHEN id % 10 = 0 THEN 'remove' ELSE 'write' END, kind FROM tree WHERE kind = 'file' AND id % 10 < 2
        UNION ALL SELECT * FROM (VALUES ('/new', 'create', 'dir'), ('/new/folder', 'create', 'dir'), ('/new/folder/a.md', 'create', 'file'))""",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "rpc_codes": _values(_MESSAGES, "message, code"),
    "rest_requests": f"""WITH {_TREE}, s AS (SELECT least(3, count(*)) AS n FROM tree WHERE kind = 'symlink')
        SELECT place::INT AS place, request, status::INT AS status, CASE WHEN place = 6 THEN (SELECT n FROM s) ELSE 0 END::INT AS hits
        FROM (VALUES (0, '/healthz', 200), (1, '/none', 404), (2, '/v1/search', 400), (3, '/v1/search', 400), (4, '/v1/search', 400), (5, '/v1/none', 404), (6, '/v1/search', 200), (7, 'requests', 7), (8, 'errors', 5)) AS t(place, request, status)""",
    "cli_outputs": f"""WITH {_TREE}, du AS (SELECT c, count(*) AS entries, sum(CASE WHEN kind = 'file' THEN size ELSE 0 END)::BIGINT AS bytes FROM tree, (VALUES ('/srv/trees'), ('')) AS r(c) WHERE path = c OR starts_with(path, c || '/') GROUP BY c)
        SELECT 'ls /srv/trees' AS command, string_split(path, '/')[4] AS item, kind AS value FROM tree WHERE len(string_split(path, '/')) = 4 AND starts_with(path, '/srv/trees/')
        UNION ALL SELECT trim('du ' || c), 'entries', entries::VARCHAR FROM du UNION ALL SELECT trim('du ' || c), 'bytes', bytes::VARCHAR FROM du
        UNION ALL SELECT 'big 0.00390625', path, size::VARCHAR FROM tree WHERE kind = 'file' AND size > 4096
        UNION ALL SELECT 'by-tag all', '', 'dir'
        UNION ALL SELECT 'query SELECT kind, count(*) AS n FROM files GROUP BY kind ORDER BY kind', kind, count(*)::VARCHAR FROM tree GROUP BY kind
        UNION ALL SELECT 'query SELECT kind, count(*) AS n FROM files GROUP BY kind ORDER BY kind', 'truncated', 'False'
        UNION ALL SELECT 'doctor', 'file_rows', count(*)::VARCHAR FROM tree
        UNION ALL SELECT 'doctor', n, '0' FROM (SELECT unnest(['repeated_paths', 'missing_parents', 'chunks_without_file', 'vectors_without_file', 'occurrences_without_chunk', 'occurrences_without_concept', 'missing_paths']) AS n)""",
}
