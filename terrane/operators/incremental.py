"""Processing only new or changed records.

:class:`CommitLog` is the bookkeeping that makes a run exact: a high watermark on a monotonic commit sequence, an
upper limit that is fixed when the run starts, and one manifest file whose appearance commits the outputs together
with the new watermark. A run that dies before it leaves only an attempt folder that no reader looks at; a run that
is repeated reads the same bounds.

:func:`due_files` tells through such a log which files the running run of each scan root has to process. Records of
earlier runs are read only above the watermark and folded into what is kept of them; :func:`changed_files` is the
comparison of one state of all tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from terrane.durable import create_once, read_file, written
from terrane.tables import latest


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def changed_files(files: DataFrame, index_state: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """The files that the running run of their root must process: ``file_id, run_id, model, reason``.

    A file's state is its row with the greatest ``indexed_at_ns``, and it counts if its kind is ``file`` then; its record is the one that the succeeded run with
    the greatest ``started_at`` left, however late it was committed. It is due if there is no record
    (``new``), if the record's model is not the running run's (``model``), or if the contents differ
    (``content``): by hash without regard to letter case, or by size or time where either hash is null or blank.

    Defined cases: rows without an id are ignored; a root without a running run gets nothing; of several running runs
    of a root the last started counts; repeated rows change nothing; empty tables give an empty result; a null model
    equals only a null model. Extra columns are never read. Records of runs that failed, were aborted or still run
    are ignored, so a repeated or resumed run sees the same files again.
    """
    return _due(files, _records(_known(index_state), scan_runs), scan_runs)


#: What is kept of a record of a run.
_RECORD = ("file_id", "run_id", "committed_at", "size", "mtime_ns", "content_hash", "model")


def _known(index_state: DataFrame) -> DataFrame:
    return index_state.filter("file_id IS NOT NULL AND run_id IS NOT NULL").select(*_RECORD)


def _finished(scan_runs: DataFrame) -> DataFrame:
    """``run_id, started_at, ended``: runs that ended, and whether they succeeded."""
    status = F.lower("status")
    ended = scan_runs.filter(F.col("run_id").isNotNull() & status.isin("succeeded", "failed", "aborted"))
    return ended.groupBy("run_id").agg(F.max(F.when(status == "succeeded", F.col("started_at"))).alias("started_at"), F.max(status == "succeeded").alias("succeeded"))


def _records(known: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """The record that counts for each file: that of the succeeded run that started last."""
    marks = known.join(_finished(scan_runs).filter("succeeded"), "run_id").withColumn("_order", F.struct("started_at", "run_id", "committed_at"))
    return latest(marks, ["file_id"], "_order", ["size", "mtime_ns", "content_hash", "model"]).select("_order.*", "file_id", "size", "mtime_ns", "content_hash", "model").select(*_RECORD)


def folded(kept: DataFrame | None, arrived: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """What must be kept of all records so far: each file's record that counts, and those of runs that have not ended.

    A record of a run that failed or was aborted never counts; one of a run that still runs may count later, though it
    lies below the watermark then.
    """
    known = arrived if kept is None else kept.unionByName(arrived)
    open_ = known.join(_finished(scan_runs).select("run_id"), "run_id", "left_anti")
    newest = latest(open_, ["file_id", "run_id"], "committed_at", ["size", "mtime_ns", "content_hash", "model"]).select(*_RECORD)
    return _records(known, scan_runs).unionByName(newest)


def _due(files: DataFrame, records: DataFrame, scan_runs: DataFrame) -> DataFrame:
    states = latest(files.filter("id IS NOT NULL"), ["id"], "indexed_at_ns", ["scan_root", "size", "mtime_ns", "content_hash", "kind"])
    current = states.filter("kind = 'file'").select(
        F.col("id").alias("file_id"),
        "scan_root",
        F.col("size").alias("now_size"),
        F.col("mtime_ns").alias("now_mtime"),
        F.lower(F.trim("content_hash")).alias("now_hash"),
    )
    runs = scan_runs.select("run_id", "scan_root", "model", "started_at", F.lower("status").alias("status"))
    running = latest(
        runs.filter("status = 'running' AND scan_root IS NOT NULL"), ["scan_root"], "started_at", ["run_id", "model"]
    ).select("scan_root", "run_id", "model")
    record = records.select(
        "file_id",
        F.lit(True).alias("recorded"),
        F.col("size").alias("was_size"),
        F.col("mtime_ns").alias("was_mtime"),
        F.lower(F.trim("content_hash")).alias("was_hash"),
        F.col("model").alias("was_model"),
    )
    unhashed = _blank(F.col("now_hash")) | _blank(F.col("was_hash"))
    moved = ~(F.col("now_size").eqNullSafe(F.col("was_size")) & F.col("now_mtime").eqNullSafe(F.col("was_mtime")))
    reason = (
        F.when(F.col("recorded").isNull(), "new")
        .when(~F.col("was_model").eqNullSafe(F.col("model")), "model")
        .when(F.when(unhashed, moved).otherwise(F.col("now_hash") != F.col("was_hash")), "content")
    )
    return (
        current.join(running, "scan_root")
        .join(record, "file_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("file_id", "run_id", "model", "reason")
    )


@dataclass(frozen=True)
class Bounds:
    """What one run reads: ``low < sequence <= high``. ``number`` is that of the commit it will make."""

    number: int
    low: int | str | None
    high: int | str | None

    @property
    def empty(self) -> bool:
        return self.high is None or (self.low is not None and self.high <= self.low)


def _whole(source: DataFrame, column: str) -> bool:
    return isinstance(source.schema[column].dataType, IntegralType)


class CommitLog:
    """Outputs and watermarks of an incremental job under ``path``, on any Hadoop file system.

    ``path/data/<attempt>/<name>`` holds outputs, ``path/commits/<number>`` one small manifest for each commit with the
    name of its attempt and its watermark. A manifest is made in one step under a name that must be free, so of two runs
    with the same bounds one commits and the other is told so. Beginning a run reads the last manifest only.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())

    def _manifest(self, number: int) -> dict:
        return json.loads(read_file(self.spark, f"{self.path}/commits/{number:020d}"))

    def _last(self) -> tuple[int, dict] | None:
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else None

    def watermark(self) -> int | str | None:
        """The highest sequence number whose record is committed; null before the first commit."""
        last = self._last()
        return last[1]["high"] if last else None

    def begin(self, source: DataFrame, sequence: str) -> Bounds:
        """Fixes the bounds of a run: above the watermark, up to the greatest sequence number there is now.

        The column ``sequence`` holds whole numbers or times; a time is kept as text, which sorts as the times do.
        """
        last = self._last()
        greatest = F.max(sequence)
        high = source.agg(greatest if _whole(source, sequence) else greatest.cast("string")).first()[0]
        return Bounds(last[0] + 1 if last else 0, last[1]["high"] if last else None, high)

    @staticmethod
    def read(source: DataFrame, sequence: str, bounds: Bounds) -> DataFrame:
        """The records of a run; the filter reaches the scan. Records with a null sequence number are not committed yet."""
        if bounds.empty:
            return source.limit(0)
        kind = source.schema[sequence].dataType
        within = F.col(sequence) <= F.lit(bounds.high).cast(kind)
        return source.filter(within if bounds.low is None else within & (F.col(sequence) > F.lit(bounds.low).cast(kind)))

    def commit(self, output: DataFrame | Mapping[str, DataFrame], bounds: Bounds) -> bool:
        """Writes the outputs and makes them and the watermark visible in one step; False if another run was first."""
        attempt = uuid.uuid4().hex
        outputs = output if isinstance(output, Mapping) else {"output": output}
        for name, df in outputs.items():
            df.write.parquet(f"{self.path}/data/{attempt}/{name}")
        high = bounds.low if bounds.empty else bounds.high  # the watermark never falls
        return create_once(self.spark, f"{self.path}/commits/{bounds.number:020d}", json.dumps({"data": attempt, "low": bounds.low, "high": high}).encode())

    def last(self, name: str = "output") -> DataFrame | None:
        """An output of the last commit; null before the first."""
        last = self._last()
        return self.spark.read.parquet(f"{self.path}/data/{last[1]['data']}/{name}") if last else None

    def output(self, name: str = "output") -> DataFrame | None:
        """An output of all commits so far."""
        done = [self._manifest(n) for n in self._numbers()]
        return self.spark.read.parquet(*(f"{self.path}/data/{m['data']}/{name}" for m in done)) if done else None

    def vacuum(self, keep: int = 2) -> int:
        """Drops all commits but the last ``keep`` and what only they hold, for jobs whose last output says everything; returns the number of attempts deleted."""
        numbers = self._numbers()
        kept = {self._manifest(n)["data"] for n in numbers[-keep:]}
        folder, gone = self._path(f"{self.path}/data"), 0
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName() not in kept:
                gone += self._fs.delete(status.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{n:020d}"), False)
        return gone


def due_files(log: CommitLog, files: DataFrame, index_state: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """``file_id, run_id, model, reason`` as :func:`changed_files` has them, by one run of an incremental job over ``log``.

    The sequence of ``index_state`` is ``committed_at``, the time at which a record came in, however late that was after
    its run. The run reads the records above the log's watermark and up to the greatest there is when it starts, folds
    them into those that the last commit kept, compares the files, and commits the due files, the kept records and the
    new watermark in one step. What is returned is read from the commit: if another run with the same bounds was
    first, its result. Records whose ``committed_at`` is null have no place in the sequence and are read by each run, which
    changes nothing when they are read again. ``files`` has no such sequence, as late rows bring older states, so it is
    read whole up to the greatest ``indexed_at_ns`` at the start.
    """
    bounds = log.begin(index_state, "committed_at")
    newest = files.agg(F.max("indexed_at_ns")).first()[0]
    now = files if newest is None else files.filter(F.col("indexed_at_ns").isNull() | (F.col("indexed_at_ns") <= newest))
    arrived = log.read(index_state, "committed_at", bounds).unionByName(index_state.filter("committed_at IS NULL"))
    kept = written(folded(log.last("records"), _known(arrived), scan_runs), "records")
    log.commit({"records": kept, "due": _due(now, _records(kept, scan_runs), scan_runs)}, bounds)
    return log.last("due")
