import fnmatch

import pytest
from pyspark.sql import functions as F

from terrane.functions import paths as P
from terrane.sources.policy import Policy, language


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "p string")


def test_parts(spark):
    got = rows(spark, "/a/b/c.Tar.GZ", "/a", "/a/.gitignore").select(P.base_name(F.col("p")), P.directory(F.col("p")), P.depth(F.col("p")), P.extension(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c.Tar.GZ", "/a/b", 4, ".gz"), ("a", "/", 2, ""), (".gitignore", "/a", 3, ".gitignore")]


def test_prefix_is_not_a_folder_but_within_is(spark):
    df = rows(spark, "/a/b", "/a/bc", "/a/b/c", "/a")
    assert {r.p for r in df.filter(P.has_prefix(F.col("p"), "/a/b")).collect()} == {"/a/b", "/a/bc", "/a/b/c"}
    assert {r.p for r in df.filter(P.within(F.col("p"), "/a/b")).collect()} == {"/a/b", "/a/b/c"}
    assert df.filter(P.within(F.col("p"), "/")).count() == 4


@pytest.mark.parametrize("glob", ["*.txt", "a?c", "[a-c]x", "requirements*.txt", "bazel-*", ".git", "a.b"])
def test_globs(spark, glob):
    names = ["a.txt", "abc", "ax", "dx", "requirements-dev.txt", "bazel-out", ".git", "xgit", "a.b", "aXb", ""]
    df = rows(spark, *names)
    assert {r.p for r in df.filter(F.col("p").rlike(P.glob_pattern(glob))).collect()} == {n for n in names if fnmatch.fnmatchcase(n, glob)}


@pytest.mark.parametrize("bad", ["", "  ", "nested/path", "a\\b", "["])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        P.validated([bad])
    with pytest.raises(ValueError):
        Policy(extra_exclude=[bad])


def test_policy(spark):
    p = Policy(extra_include=["*.special"], extra_exclude=["generated*"])
    names = {"a.md": True, "a.MD": True, "Makefile": True, "a.bin": False, "x.special": True, "requirements-x.txt": True, "notes.txt": False, "Dockerfile.dev": True}
    df = rows(spark, *names)
    assert {r.p: r.i for r in df.select("p", p.includes(F.col("p"), F.lit("file")).alias("i")).collect()} == names
    assert df.filter(Policy(all_files=True).includes(F.col("p"), F.lit("file"))).count() == len(names)
    paths = {"/r/src/a.go": False, "/r/node_modules/a.js": True, "/r/x/.git": True, "/r/bazel-out/a": True, "/r/generated_1/a": True, "/r": False, "/r/Cargo.lock": False}
    got = rows(spark, *paths).select("p", p.excludes(F.col("p"), "/r").alias("e")).collect()
    assert {r.p: r.e for r in got} == paths
    # the root itself is never denied
    assert not rows(spark, "/x/build/a.c").select(p.excludes(F.col("p"), "/x/build")).first()[0]
    assert [r[0] for r in rows(spark, "a.tsx", "b.H", "c").select(language(F.col("p"))).collect()] == ["typescript", "c", ""]
