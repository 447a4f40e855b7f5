"""Queries on incremental processing."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrane.durable import shared_dir
from terrane.operators.incremental import CommitLog, due_files
from terrane.tables import table


def _due(spark: SparkSession, d: str) -> DataFrame:
    """The first run over a log of its own."""
    log = CommitLog(spark, f"{shared_dir(spark).rstrip('/')}/due-{uuid.uuid4().hex}")
    return due_files(log, table(spark, d, "files"), table(spark, d, "index_state"), table(spark, d, "scan_runs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _due(spark, d).select("file_id")


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _due(spark, d).groupBy("run_id", "reason").count().withColumnRenamed("count", "n_files")


_DUE = """
WITH cur AS (
  SELECT * FROM (
    SELECT id, kind, scan_root, size, mtime_ns, lower(trim(content_hash)) AS h,
           row_number() OVER (PARTITION BY id ORDER BY indexed_at_ns DESC, scan_root DESC, size DESC, mtime_ns DESC) AS rn
    FROM files WHERE id IS NOT NULL) WHERE rn = 1 AND kind = 'file'),
ok AS (SELECT run_id, max(started_at) AS started_at FROM scan_runs WHERE status = 'succeeded' GROUP BY run_id),
rec AS (
  SELECT * FROM (
    SELECT i.file_id, i.size, i.mtime_ns, i.model, lower(trim(i.content_hash)) AS h,
           row_number() OVER (PARTITION BY i.file_id ORDER BY o.started_at DESC, i.run_id DESC, i.committed_at DESC) AS rn
    FROM index_state i JOIN ok o USING (run_id)) WHERE rn = 1),
run AS (SELECT DISTINCT run_id, scan_root, model FROM scan_runs WHERE status = 'running'),
due AS (
  SELECT cur.id AS file_id, run.run_id,
    CASE WHEN rec.file_id IS NULL THEN 'new'
         WHEN rec.model IS DISTINCT FROM run.model THEN 'model'
         WHEN CASE WHEN coalesce(cur.h, '') = '' OR coalesce(rec.h, '') = ''
                   THEN cur.size IS DISTINCT FROM rec.size OR cur.mtime_ns IS DISTINCT FROM rec.mtime_ns
                   ELSE cur.h <> rec.h END THEN 'content' END AS reason
  FROM cur JOIN run USING (scan_root) LEFT JOIN rec ON rec.file_id = cur.id)
"""

QUERIES = {"p7_found": p7_found, "p7_reasons": p7_reasons}
SQL = {
    "p7_found": _DUE + "SELECT file_id FROM due WHERE reason IS NOT NULL",
    "p7_reasons": _DUE + "SELECT run_id, reason, count(*) AS n_files FROM due WHERE reason IS NOT NULL GROUP BY ALL",
}
