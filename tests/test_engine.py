import os

import pytest

from terrane.engine import Engine, Options
from terrane.errors import Closed, InvalidQuery, NotIndexed, UnsafePath
from terrane.operators.retrieval import Request

GO = "package a\n\nfunc (w *Worker) RebuildIndex(a int) int {\n\treturn helper(a)\n}\n\nfunc helper(a int) int { return a }\n"


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    root = base / "tree"
    put(root, **{"docs__readme.md": "hello agent database\n\n## Kalman filter\n\n## State space\n", "worker.go": GO, "docs__cache.md": "缓存 一致性\n\n## 缓存\n\n## 内存\n", "docs__memory.md": "## 内存\n"})
    (root / "blob.bin").write_bytes(b"\0\1\2\3")
    e = Engine(spark, str(base / "index"), Options(dimensions=64))
    result = e.scan(str(root), tags=["project"])
    return e, root, result


def test_build_and_queries(built):
    e, root, result = built
    assert result.entries == 6
    rows = {r.path.removeprefix(str(root)): r for r in e.table("files").collect()}
    assert set(rows) == {"", "/docs", "/docs/readme.md", "/docs/cache.md", "/docs/memory.md", "/worker.go"}
    assert rows["/docs/readme.md"].parent_id == rows["/docs"].id and rows["/docs"].parent_id == rows[""].id and rows[""].parent_id is None
    assert rows[""].tags_text == "project" and rows["/docs"].mime == "inode/directory"
    assert [r.path for r in e.by_tag("project").collect()] == [str(root)]
    assert [r.name for r in e.list(str(root)).collect()] == ["docs", "worker.go"]
    assert tuple(e.disk_usage(str(root)).first()) == (6, sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f != "blob.bin"))
    assert [r.path for r in e.find("agent database").collect()] == [str(root / "docs/readme.md")]
    with pytest.raises(InvalidQuery):
        e.find("what is it")
    assert [r.related for r in e.related("Kalman filter").collect()] == ["State space"]
    assert {r.path.rsplit("/", 1)[1] for r in e.concept_occurrences("内存").collect()} == {"cache.md", "memory.md"}
    assert [(r.caller_symbol, r.line) for r in e.callers("helper").collect()] == [("RebuildIndex", 4)]
    assert [r.callee_symbol for r in e.callees("RebuildIndex").collect()] == ["helper"]
    assert e.query("SELECT count(*) FROM files WHERE kind = 'file'").rows == [(4,)]
    with pytest.raises(InvalidQuery):
        e.query("DELETE FROM files")
    assert not any(v for k, v in e.check().items() if k != "file_rows")


def test_search_and_context(built):
    e, root, _ = built
    top = e.search("RebuildIndex").first()
    assert (top.path, top.chunk_symbol, top.start_line, top.place) == (str(root / "worker.go"), "Worker.RebuildIndex", 3, 1)
    pack = e.context_pack("RebuildIndex").collect()
    assert "func helper" in pack[0].content and "// Worker.RebuildIndex lines 3-5" in pack[0].content and not pack[0].truncated
    tiny = e.context_pack("RebuildIndex", budget=30).collect()
    assert tiny[0].truncated and tiny[0].estimated_tokens <= 30
    assert [r.path for r in e.search("", Request(kinds=("dir",), limit=1)).collect()]
    with pytest.raises(ValueError, match="filter"):
        e.search("", Request())


def test_concept_arm_finds_more(spark, built):
    e, root, _ = built
    without = {r.path for r in e.search("缓存").collect()}
    fused = Engine(spark, e.path, Options(dimensions=64, concept_fusion=True))
    assert str(root / "docs/memory.md") in {r.path for r in fused.search("缓存").collect()}
    assert str(root / "docs/cache.md") in without


def test_reranker_and_its_failure(spark, built):
    e, _, _ = built
    logits = Engine(spark, e.path, Options(dimensions=64, reranker=lambda q, docs: [float(len(d)) for d in docs]))
    assert all(r.rerank_score is not None for r in logits.search("hello agent").collect())

    def broken(q, docs):
        raise RuntimeError

    assert Engine(spark, e.path, Options(dimensions=64, reranker=broken)).search("hello agent").first().path.endswith("readme.md")


def test_rescan_sync_and_changes(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, **{"old__a.md": "alpha words", "old__nested__b.md": "beta words", "c.md": "gamma"})
    e = Engine(spark, str(tmp_path / "index"), Options(dimensions=32))
    with pytest.raises(NotIndexed):
        e.sync([str(root)])
    e.scan(str(root))
    ids = {r.path: r.id for r in e.table("files").collect()}
    vectors = {r.file_id: r.updated_at_ns for r in e.table("embeddings").collect()}
    put(root, **{"c.md": "gamma has changed", "d.md": "delta"})
    os.remove(root / "old/a.md")
    e.scan(str(root), skip_unchanged=True)
    now = {r.path: r.id for r in e.table("files").collect()}
    assert str(root / "old/a.md") not in now and now[str(root / "c.md")] == ids[str(root / "c.md")]
    later = {r.file_id: r.updated_at_ns for r in e.table("embeddings").collect()}
    same, changed = ids[str(root / "old/nested/b.md")], ids[str(root / "c.md")]
    assert later[same] == vectors[same] and later[changed] != vectors[changed] and ids[str(root / "old/a.md")] not in later
    assert [r.path for r in e.find("changed").collect()] == [str(root / "c.md")] and e.find("alpha").count() == 0

    put(root, **{"e.md": "epsilon"})
    os.remove(root / "d.md")
    assert e.sync([str(root / "e.md"), str(root / "d.md")], batch=1) == 2
    assert e.sync([str(root / "e.md")], batch=1) == 0
    paths = {r.path.removeprefix(str(root)) for r in e.table("files").collect()}
    assert "/e.md" in paths and "/d.md" not in paths

    e.tag(str(root / "old/nested/b.md"), "kept")
    e.rename(str(root / "old"), str(root / "new"))
    assert (root / "new/nested/b.md").exists() and [r.path for r in e.by_tag("kept").collect()] == [str(root / "new/nested/b.md")]
    e.untag(str(root / "new/nested/b.md"), "kept")
    assert e.by_tag("kept").count() == 0
    with pytest.raises(OSError, match="empty"):
        e.remove(str(root / "new"))
    with pytest.raises(UnsafePath):
        e.remove(str(tmp_path), recursive=True)
    e.remove(str(root / "new"), recursive=True)
    assert not (root / "new").exists() and not [f for f in os.listdir(root) if f.startswith(".terrane")]
    assert {r.path.removeprefix(str(root)) for r in e.table("files").collect()} == {"", "/c.md", "/e.md"}
    assert {x.state for x in e.journal.entries()} == {"done"} and not any(v for k, v in e.check().items() if k != "file_rows")
    before = e.store.current().number
    e.rebuild()
    assert e.store.current().number == before + 1 and e.store.vacuum(1) > 0 and e.table("files").count() == 3
    e.close()
    with pytest.raises(Closed):
        e.table("files")


def test_a_sync_writes_parts_and_many_parts_are_put_together(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, **{"a.md": "alpha words", "b.md": "beta words"})
    e = Engine(spark, str(tmp_path / "index"), Options(dimensions=32, most_parts=2))
    e.scan(str(root))
    first = e.store.current()
    put(root, **{"b.md": "beta has changed"})
    e.sync([str(root / "b.md")])
    second = e.store.current()
    assert second.tables["chunks"][0] == first.tables["chunks"][0] and len(second.tables["chunks"]) == 2
    assert {r.content for r in e.table("chunks").collect()} == {"alpha words", "beta has changed"}
    assert e.find("words").count() == 1 and e.find("changed").count() == 1
    put(root, **{"sub__c.md": "gamma words"})
    e.sync([str(root / "sub" / "c.md")])
    e.sync([str(root / "sub")])
    now = e.store.current()
    assert all(len(parts) <= 2 for parts in now.tables.values())
    rows = {r.path.removeprefix(str(root)): r for r in e.table("files").collect()}
    assert set(rows) == {"", "/a.md", "/b.md", "/sub", "/sub/c.md"} and rows["/sub/c.md"].parent_id == rows["/sub"].id
    assert e.find("words").count() == 2 and not any(v for k, v in e.check().items() if k != "file_rows")


def test_migration_by_steps_makes_the_indexes(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, **{"a.md": "alpha words\n\n## Kalman filter\n\n## State space\n"})
    e = Engine(spark, str(tmp_path / "index"), Options(dimensions=32))
    e.scan(str(root))
    v = e.store.current()
    old = {n: e.table(n, v) for n in ("files", "chunks", "symbols", "symbol_refs", "tags", "embeddings", "scan_roots")}
    old["files"] = old["files"].drop("search_text")
    from terrane.snapshot import Store

    store = Store(spark, str(tmp_path / "older"))
    store.publish({**old, "chunk_embeddings": e.table("chunk_embeddings", v).drop("file_id")}, schema=1)
    new = Engine(spark, str(tmp_path / "older"), Options(dimensions=32))
    assert new.store.current().schema == v.schema and new.find("alpha").count() == 1
    assert [r.related for r in new.related("Kalman filter").collect()] == ["State space"]
    assert new.search("alpha").first().path == str(root / "a.md")


def test_a_hit_by_meaning_alone_shows_its_nearest_chunk(spark):
    from terrane.operators.retrieval import fuse

    files = spark.createDataFrame([(1, "/a", "file", 1, 1, "", ""), (2, "/b", "file", 1, 1, "", "")], "id long, path string, kind string, size long, mtime_ns long, mime string, tags_text string")
    queries = spark.createDataFrame([(1, "words")], "query_id long, query_text string")
    vectors = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9)], "query_id long, id long, cosine double")
    near = spark.createDataFrame([(1, 1, 0.8, "text", "f", 3, 9), (1, 2, 0.7, "text", "g", 4, 8)], "query_id long, id long, cosine double, snippet string, chunk_symbol string, start_line long, end_line long")
    hits = {r.id: r for r in fuse(queries, files, Request(), 2, vectors=vectors, near_chunks=near).collect()}
    assert (hits[1].chunk_symbol, hits[1].start_line, hits[1].end_line, hits[1].snippet, hits[1].vector_score) == ("f", 3, 9, "text", 0.8)
    assert (hits[2].chunk_symbol, hits[2].start_line, hits[2].vector_score) == ("", 0, 0.9)
    # words rank the file: its snippet stays, the nearer chunk gives its cosine only
    words = spark.createDataFrame([(1, 1, 1, "by words")], "query_id long, id long, rank int, snippet string")
    ranked = {r.id: r for r in fuse(queries, files, Request(), 2, words=words, vectors=vectors, near_chunks=near).collect()}
    assert (ranked[1].chunk_symbol, ranked[1].snippet, ranked[1].vector_score) == ("", "by words", 0.8)
