"""Changes of many files: what is planned must not grow with their number, nor with the number of versions."""

import json
import os
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from terrane.engine import Engine, Options
from terrane.functions import vectors
from terrane.snapshot import Store
from terrane.sources import extract, tree


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def deep(tmp_path):
    for i in range(40):
        os.makedirs(tmp_path / f"a/b{i}/c{i % 3}/.git")
        (tmp_path / f"a/b{i}/c{i % 3}/f.md").write_text(f"text {i}")
        (tmp_path / f"a/b{i}/.git").mkdir()
    os.symlink("b1", tmp_path / "a/link")
    (tmp_path / "top.md").write_text("top")
    return tmp_path


def test_many_paths_take_few_partitions(deep):
    paths = [str(deep / f"a/p{i}") for i in range(5000)]
    reader = tree._Reader({"root": str(deep), "paths": json.dumps([*paths, str(deep / "a/p7/below")])})
    parts = reader.partitions()
    assert len(parts) <= tree.PARTITIONS
    assert sorted(p for part in parts for _, p in part.value) == sorted(paths)


def test_topmost_paths():
    assert tree.topmost(["/a/b", "/a", "/ab", "/a/b/c", "/ab-c", "/a/b"]) == ["/a", "/ab", "/ab-c"]
    assert tree.topmost(["/", "/a"]) == ["/"]


@pytest.mark.parametrize("units", [1, 3, 20, 1000])
def test_units_hold_each_entry_once(deep, units, monkeypatch):
    monkeypatch.setattr(tree, "UNITS", units)
    walk = tree._Walk({"root": str(deep), "all_files": "true"})
    want = sorted([walk.entry(str(deep)), *walk.below(str(deep))])
    assert sorted(r for kind, path in walk.units() for r in walk.listed(kind, path)) == want
    assert len(walk.units()) >= min(units, 40)


def test_listing_of_an_engine_is_that_of_the_source(spark, deep):
    engine = Engine(spark, str(deep / "index"), Options(all_files=True))
    listing = engine.listing(str(deep))
    want = spark.read.format("tree").option("root", str(deep)).option("all_files", "true").option("database", engine.path).load()
    assert sorted(map(tuple, listing.collect())) == sorted(tuple(r) for r in want.collect() if not r.path.startswith(engine.path))
    assert "tree" not in plan(listing).split("== Physical Plan ==")[1]  # a source of Python keeps processes beside the driver
    assert engine.listing(str(deep), []).count() == 0
    assert [r.path for r in engine.listing(str(deep), [str(deep / "a/b3")]).filter("kind = 'file'").collect()] == [str(deep / "a/b3/c0/f.md")]


def test_parts_are_read_by_one_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    version, want = None, {}
    for n in range(5):
        rows = spark.range(n * 10, n * 10 + 15).select(F.col("id").alias("file_id"), F.lit(n).alias("n"))
        version = store.publish({"t": rows} if version is None else {}, version, added={"t": rows} if version else None, replaced={None: rows} if version else None)
        want |= {i: n for i in range(n * 10, n * 10 + 15)}
    for reader in (store, Store(spark, str(tmp_path))):
        df = reader.read("t", key="file_id")
        assert {r.file_id: r.n for r in df.collect()} == want and df.count() == len(want)
        assert "Union" not in plan(df)
    wide = store.publish({}, version, added={"t": spark.range(100, 101).select(F.lit(7).cast("long").alias("n"), F.col("id").alias("file_id"))})
    assert store.read("t", wide, "file_id").filter("file_id = 100").first().n == 7


def test_vectors_are_made_without_a_shuffle(spark):
    texts = ["alpha beta alpha", None, "", "x" * 30_000 + " beta", "漢字 kana", *(f"word{i} word{i % 7}" for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("kept", F.col("id") + 1)
    made = vectors.hash_vectors(df, dimensions=64, keep=["kept"])
    assert "Exchange" not in plan(made)
    assert not vectors.unit_rows(pa.array([[], []], pa.list_(pa.string())), 32).any()
    terms = {r.id: r.t for r in df.select("id", vectors.analyze_terms(F.col("text")).alias("t")).collect()}
    for r in made.collect():
        want = np.zeros(64)
        for t in terms[r.id]:
            h = 14695981039346656037
            for b in t.encode():
                h = (h ^ b) * 1099511628211 % (1 << 64)
            want[h % 64] += -1 if h >> 63 else 1
        length = np.sqrt((want * want).sum())
        assert np.array_equal(np.float32(want / length if length else want), np.float32(r.vector)) and r.kept == r.id + 1


def test_texts_are_read_where_the_files_are(spark, deep):
    (deep / "a.py").write_text("def f():\n    return g()\n")
    (deep / "b.docx").write_bytes(b"no archive")
    entries = spark.createDataFrame([(str(p), "file") for p in (deep / "a.py", deep / "b.docx", deep / "top.md", deep / "gone")], "path string, kind string")
    want = extract.extract_files(extract.read_contents(entries))
    got = extract.read_texts(entries)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_tables_of_a_version_are_written_side_by_side(spark, tmp_path, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (both.wait(), plain(self, *a, **k))[1])
    store = Store(spark, str(tmp_path))
    version = store.publish({"a": spark.range(3), "b": spark.range(4)})
    assert (store.read("a", version).count(), store.read("b", version).count()) == (3, 4)
    monkeypatch.undo()
    with pytest.raises(Exception, match="broken"):
        store.publish({"a": spark.range(3), "c": spark.range(1).select(F.raise_error(F.lit("broken")))}, version)
    assert store.current().number == version.number and "c" not in store.current().tables
