"""Queries on source code: what a scan finds in the contents of files. SQL can't parse; tests hold them against fixtures."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.relational import current_files
from terrane.sources.extract import extract_files
from terrane.tables import table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    files = current_files(table(spark, d, "files"), ["path", "kind", "content_head"]).filter("kind = 'file' AND content_head <> ''")
    return extract_files(files.select("path", F.encode("content_head", "UTF-8").alias("content")))


def code_chunks(spark, d):
    return _parsed(spark, d).select("path", "language", F.explode("chunks").alias("c")).select("path", "language", "c.ordinal", "c.symbol", "c.start_line", "c.end_line", "c.content_hash")


def code_symbols(spark, d):
    return _parsed(spark, d).select("path", F.explode("symbols").alias("s")).select("path", "s.symbol", "s.start_line", "s.end_line")


def symbol_callers(spark, d):
    refs = _parsed(spark, d).select("path", F.explode("refs").alias("r"))
    return refs.groupBy(F.col("r.callee").alias("callee")).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("path", "r.caller").alias("callers"))


QUERIES = {f.__name__: f for f in (code_chunks, code_symbols, symbol_callers)}
SQL: dict[str, str] = {}
