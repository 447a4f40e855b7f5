"""Access to the tables of an index, and the rules that turn raw rows into current ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``, one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: Iterable[str], version: str, columns: Iterable[str]) -> DataFrame:
    """Of the rows with equal ``keys`` the one with the greatest ``version``.

    Rows that tie on the version are told apart by their other columns, so the choice does not depend on the order
    of the input; a null version is lower than any other. The maximum is aggregated before the shuffle, so one key
    with a third of all rows costs one row a task.
    """
    keys, columns = list(keys), [c for c in columns if c != version]
    best = F.max(F.struct(F.col(version), *(F.col(c) for c in columns))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in [version, *columns]))


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that is heavy for each row: if it is a plain scan of fewer pieces than there are cores, its rows
    are dealt out to all of them.

    A scan can't split a row group, so a small file with much text keeps one core busy. A table that is read in at
    least as many pieces as there are cores, as any large one is, stays as it is and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":  # it has a shuffle already
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
