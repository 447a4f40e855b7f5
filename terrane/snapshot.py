"""Versions of an index: immutable Parquet parts of tables and one pointer that is moved when a version is complete.

A table of a version is a list of parts, each with the number of the version that wrote it, and a version also lists the
files that were replaced, by their ids: a row counts unless its file was replaced after its part was written. A change of a
few files thus writes a few rows, and parts are shared with the version before. Readers resolve the pointer once; a build
that fails leaves the pointer, and thus every reader, where it was.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrane.durable import at_once, create_once, read_file
from terrane.errors import IncompatibleSchema

SCHEMA_VERSION = 4


@dataclass(frozen=True)
class Version:
    """A published version: its number, the parts of its tables as (folder, number), those of the ids of replaced files as
    (folder, number, tables or null for all), the batches of changes that it holds, and the greatest ids given so far."""

    number: int
    tables: Mapping[str, list]
    batches: Mapping[str, int] = field(default_factory=dict)
    schema: int = SCHEMA_VERSION
    replaced: list = field(default_factory=list)
    counters: Mapping[str, int] = field(default_factory=dict)


def _parts(known: str | list, number: int = 0) -> list:
    """Parts as they are kept; a single folder is what older versions hold."""
    return [[known, number]] if isinstance(known, str) else [list(p) for p in known]


class Store:
    """The versions under ``path``, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._schemas: dict[str, StructType] = {}  # by folder, whose files never change
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())

    def current(self) -> Version | None:
        """The latest version, or null for an empty store. A version of a newer schema is refused."""
        numbers = self._numbers()
        if not numbers:
            return None
        found = json.loads(read_file(self.spark, f"{self.path}/versions/{numbers[-1]:020d}"))
        if not 0 <= found.get("schema", 0) <= SCHEMA_VERSION:
            raise IncompatibleSchema(f"schema {found['schema']} is newer than {SCHEMA_VERSION}")
        return Version(found["number"], {n: _parts(t) for n, t in found["tables"].items()}, found.get("batches", {}), found["schema"], found.get("replaced", []), found.get("counters", {}))

    def read(self, name: str, version: Version | None = None, key: str | None = None) -> DataFrame:
        """A table of a version. ``key`` is its column of file ids; a table without one is always a single part."""
        version = version or self.current()
        if version is None or name not in version.tables:
            raise LookupError(f"no table {name}")
        parts = version.tables[name]
        oldest = min(n for _, n in parts)
        later = [(f, n) for f, n, only in version.replaced if n > oldest and (only is None or name in only)]
        if not later or key is None:
            return self._scan([f for f, _ in parts])
        rows = self._numbered(parts)
        replaced = self._numbered(later).groupBy("file_id").agg(F.max("_n").alias("_replaced")).withColumnRenamed("file_id", "_file")
        alive = rows.join(replaced, F.col(key) == F.col("_file"), "left").filter(F.col("_replaced").isNull() | (F.col("_n") >= F.col("_replaced")))
        return alive.drop("_n", "_file", "_replaced")

    def _numbered(self, parts: list) -> DataFrame:
        """The rows of all parts by one scan, with the number of their part, which is told by the folder of their file."""
        rows = self._scan([f for f, _ in parts])
        if len({n for _, n in parts}) == 1:
            return rows.withColumn("_n", F.lit(parts[0][1]))
        numbers = F.create_map(*(F.lit(x) for f, n in parts for x in (f.rsplit("/", 1)[-1], n)))
        return rows.withColumn("_n", numbers[F.element_at(F.split("_metadata.file_path", "/"), -2)])

    def _schema(self, folder: str) -> StructType:
        if folder not in self._schemas:
            self._schemas[folder] = self.spark.read.parquet(f"{self.path}/{folder}").schema
        return self._schemas[folder]

    def _scan(self, folders: list[str]) -> DataFrame:
        """Parts of a table, all with the columns of the first."""
        return self.spark.read.schema(self._schema(folders[0])).parquet(*(f"{self.path}/{f}" for f in folders))

    def publish(
        self,
        tables: Mapping[str, DataFrame],
        base: Version | None = None,
        batches: Mapping[str, int] | None = None,
        added: Mapping[str, DataFrame] | None = None,
        replaced: Mapping[tuple[str, ...] | None, DataFrame] | None = None,
        counters: Mapping[str, int] | None = None,
        schema: int = SCHEMA_VERSION,
    ) -> Version:
        """Writes tables and makes a version of them and of the other tables of ``base``.

        ``added`` are rows that come on top of a table's; ``replaced`` gives for some tables, or with the key null for all that
        are read by their file ids, the files (``file_id``) whose earlier rows no longer count. Of two publications on the same base one wins and the
        other raises ``RuntimeError``; what it wrote is never seen.
        """
        number = (base.number if base else 0) + 1
        paths = {n: [list(p) for p in parts] for n, parts in (base.tables if base else {}).items()}
        written: dict[str, DataFrame] = {}
        for name, df in {**tables, **(added or {})}.items():
            folder = f"tables/{name}/{uuid.uuid4().hex}"
            if name in (added or {}) and paths.get(name):  # all parts have the columns and types of the first
                df = df.select(*(F.col(c.name).cast(c.dataType) for c in self._schema(paths[name][0][0])))
            written[folder] = df
            paths[name] = [*(paths.get(name, []) if name in (added or {}) else []), [folder, number]]
        gone = [list(p) for p in (base.replaced if base else [])]
        for only, ids in (replaced or {}).items():
            folder = f"tables/replaced/{uuid.uuid4().hex}"
            written[folder] = ids.select("file_id").distinct()
            gone.append([folder, number, None if only is None else list(only)])
        at_once(*(functools.partial(df.write.parquet, f"{self.path}/{folder}") for folder, df in written.items()))
        self._schemas |= {folder: df.schema for folder, df in written.items()}
        oldest = min((n for parts in paths.values() for _, n in parts), default=number)
        gone = [p for p in gone if p[1] > oldest]
        version = Version(
            number, paths, {**(base.batches if base else {}), **(batches or {})}, schema, gone, {**(base.counters if base else {}), **(counters or {})}
        )
        manifest = json.dumps({"number": version.number, "tables": paths, "batches": version.batches, "schema": version.schema, "replaced": gone, "counters": version.counters})
        if not create_once(self.spark, f"{self.path}/versions/{version.number:020d}", manifest.encode()):
            raise RuntimeError(f"version {version.number} was published by another writer")
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what only older versions than the last ``keep`` need; returns the number of folders."""
        numbers = self._numbers()
        kept: set[str] = set()
        for n in numbers[-keep:]:
            found = json.loads(read_file(self.spark, f"{self.path}/versions/{n:020d}"))
            kept |= {f for t in found["tables"].values() for f, _ in _parts(t)} | {p[0] for p in found.get("replaced", [])}
        gone = 0
        tables = self._path(f"{self.path}/tables")
        for table in self._fs.listStatus(tables) if self._fs.exists(tables) else []:
            for folder in self._fs.listStatus(table.getPath()):
                relative = f"tables/{table.getPath().getName()}/{folder.getPath().getName()}"
                if relative not in kept:
                    self._fs.delete(folder.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{n:020d}"), False)
        return gone
