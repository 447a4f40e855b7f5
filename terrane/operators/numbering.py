"""Dense numbers in the order of a key, without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.durable import checkpointed


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name`` = first, first + 1, ... in ascending order of the columns ``order``.

    Rows are range-partitioned by the order and counted by partition; a row's number is the count of the partitions
    before its own and its place within. The ranges are cut before they are counted, so that the loss of an executor
    can't change them.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # one row a partition
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place") + F.lit(first - 1)).drop("_part", "_place", "_before")
