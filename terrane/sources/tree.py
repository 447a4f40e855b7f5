"""A folder tree as a Spark data source: one row for each entry, as a batch or as a stream of changes."""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from terrane.functions.paths import any_glob, validated
from terrane.sources.policy import EXCLUDE_PATTERNS, INCLUDE_EXTENSIONS, INCLUDE_PATTERNS

_SCHEMA = "path string, name string, kind string, size long, mtime_ns long, link_target string"


class _Walk:
    """Listing under a policy. Denied folders are not entered; what vanishes meanwhile is left out."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["root"])
        self.all_files = str(options.get("all_files", "false")).lower() == "true"
        extra_in = validated([p for p in options.get("include", "").split(",") if p.strip()])
        extra_out = validated([p for p in options.get("exclude", "").split(",") if p.strip()])
        self.names = re.compile(any_glob([*INCLUDE_PATTERNS, *extra_in]))
        self.denied = re.compile(any_glob([*EXCLUDE_PATTERNS, *extra_out]))
        own = options.get("database", "")
        self.artifacts = {own, *(f"{own}-{x}" for x in ("wal", "shm", "journal"))} if own else set()

    def wanted(self, name: str) -> bool:
        return self.all_files or os.path.splitext(name)[1].lower() in INCLUDE_EXTENSIONS or bool(self.names.match(name))

    def entry(self, path: str) -> tuple | None:
        try:
            s = os.lstat(path)
            target = os.readlink(path) if stat.S_ISLNK(s.st_mode) else ""
        except OSError:
            return None
        kind = "symlink" if stat.S_ISLNK(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
        return (path, os.path.basename(path), kind, 0 if kind == "dir" else s.st_size, s.st_mtime_ns, target)

    def children(self, folder: str) -> Iterator[tuple]:
        """Admitted entries of a folder."""
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            path = os.path.join(folder, name)
            if self.denied.match(name) or path in self.artifacts:
                continue
            row = self.entry(path)
            if row and (row[2] != "file" or self.wanted(name)):
                yield row

    def at(self, path: str) -> Iterator[tuple]:
        """A path of the tree and all below it, if the policy admits it and every folder that leads to it."""
        if path == self.root:
            way = []
        elif path.startswith(self.root.rstrip("/") + "/"):
            way = path[len(self.root.rstrip("/")) + 1 :].split("/")
        else:
            return
        if any(self.denied.match(c) for c in way) or path in self.artifacts:
            return
        row = self.entry(path)
        if row and (row[2] != "file" or not way or self.wanted(way[-1])):
            yield row
            if row[2] == "dir":
                yield from self.below(path)

    def below(self, folder: str) -> Iterator[tuple]:
        for row in self.children(folder):
            yield row
            if row[2] == "dir":
                yield from self.below(row[0])

    def folders(self, folder: str) -> list[str]:
        """Admitted folders in a folder."""
        try:
            with os.scandir(folder) as entries:
                return sorted(e.path for e in entries if not self.denied.match(e.name) and e.path not in self.artifacts and e.is_dir(follow_symlinks=False))
        except OSError:
            return []

    def units(self) -> list[tuple[str, str]]:
        """The tree in pieces that can be listed apart: folders level by level, until there are enough that are listed with all below."""
        out, whole = [("root", self.root)], self.folders(self.root)
        while whole and len(whole) < UNITS:
            out += [("children", f) for f in whole]
            whole = [f for folder in whole for f in self.folders(folder)]
        return out + [("below", f) for f in whole]

    def listed(self, kind: str, path: str) -> Iterator[tuple]:
        """The entries of a unit, or those at and below a given path."""
        if kind == "root":
            own = self.entry(path)
            if own:
                yield own
        if kind in ("root", "children"):
            yield from self.children(path)
        elif kind == "at":
            yield from self.at(path)
        elif kind == "below":
            yield from self.below(path)


#: A tree is listed in at least so many units, if it has so many folders, by at most so many partitions.
UNITS, PARTITIONS = 256, 32


def topmost(paths: Iterable[str]) -> list[str]:
    """The paths, absolute and in order, without those that lie below another, as they come with it."""
    given = {os.path.abspath(p) for p in paths}

    def covered(path: str) -> bool:
        while (above := os.path.dirname(path)) != path:
            if above in given:
                return True
            path = above
        return False

    return [p for p in sorted(given) if not covered(p)]


def _units(walk: _Walk, options: dict) -> list[list[tuple[str, str]]]:
    """The units of a listing, dealt out to partitions."""
    units = [("at", p) for p in topmost(json.loads(options["paths"]))] if "paths" in options else walk.units()
    return [units[n::PARTITIONS] for n in range(min(PARTITIONS, len(units)))] or [[]]


class _Reader(DataSourceReader):
    """Some partitions, each with some folders or given paths."""

    def __init__(self, options: dict) -> None:
        self.walk, self.options = _Walk(options), options

    def partitions(self):
        return [InputPartition(units) for units in _units(self.walk, self.options)]

    def read(self, partition):
        for kind, path in partition.value:
            yield from self.walk.listed(kind, path)


def entries(spark: SparkSession, options: dict) -> DataFrame:
    """What the source lists for the same options, without the processes that Spark keeps beside the driver to plan a source of Python."""
    walk = _Walk(options)
    dealt = [u for units in _units(walk, options) for u in units]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            text, whole = pa.string(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (text, text, text, whole, whole, text), strict=True)], names)

        rows: list[tuple] = []
        for units in batches:
            for kind, path in zip(*(c.to_pylist() for c in units.columns), strict=True):
                for row in walk.listed(kind, path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    units = pa.table({"unit": pa.array([k for k, _ in dealt], pa.string()), "path": pa.array([p for _, p in dealt], pa.string())})
    return spark.createDataFrame(units).mapInArrow(run, _SCHEMA)


class _Changes(SimpleDataSourceStreamReader):
    """Entries that appeared, changed or vanished since the listing before. The first listing reports all as created."""

    def __init__(self, options: dict) -> None:
        self.walk = _Walk(options)
        self.known: dict[str, tuple] = {}
        self.kept: dict[int, list[tuple]] = {}

    def initialOffset(self):
        return {"listing": 0}

    def _listing(self) -> dict[str, tuple]:
        own = self.walk.entry(self.walk.root)
        rows = [own, *self.walk.below(self.walk.root)] if own else []
        return {r[0]: r for r in rows}

    def read(self, start):
        now = self._listing()
        rows = [(p, "create" if p not in self.known else "write", *r[1:]) for p, r in now.items() if self.known.get(p) != r]
        rows += [(p, "remove", *r[1:]) for p, r in self.known.items() if p not in now]
        self.known = now
        at = start["listing"]
        if not rows:
            return iter(()), start
        self.kept[at] = rows
        return iter(rows), {"listing": at + 1}

    def commit(self, end):
        """Listings that are processed are forgotten, and no others."""
        for at in [at for at in self.kept if at < end["listing"]]:
            del self.kept[at]

    def readBetweenOffsets(self, start, end):
        return iter([r for at in range(start["listing"], end["listing"]) for r in self.kept.get(at, [])])


class TreeSource(DataSource):
    """``spark.read.format("tree").option("root", path)``; as a stream each row has an ``event``: create, write or remove.

    Options: ``include`` and ``exclude`` (more patterns, by commas), ``all_files``, ``database`` (the index itself), and as a
    batch ``paths`` (a JSON list), to which the listing is restricted.
    """

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


class TreeChangesSource(DataSource):
    """``spark.readStream.format("tree_changes").option("root", path)``: a row for each entry that appeared, changed or vanished."""

    @classmethod
    def name(cls):
        return "tree_changes"

    def schema(self):
        return "path string, event string, name string, kind string, size long, mtime_ns long, link_target string"

    def simpleStreamReader(self, schema):
        return _Changes(dict(self.options))


def register(spark) -> None:
    """Makes both sources known to a session."""
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(TreeChangesSource)
