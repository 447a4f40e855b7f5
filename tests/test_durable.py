import os

from terrane import durable
from terrane.operators.numbering import numbered
from terrane.tables import latest, spread


def test_tables_and_checkpoints_lie_in_the_named_folder(spark):
    folder = durable.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    df = durable.written(spark.range(10).withColumnRenamed("id", "n"), "numbers")
    assert df.count() == 10 and any(f.startswith("numbers-") for f in os.listdir(folder))
    cut = durable.checkpointed(spark.range(5))
    assert cut.count() == 5 and spark.sparkContext.getCheckpointDir() is not None
    empty = durable.written(spark.range(5).filter("id < 0"), "none")
    assert empty.count() == 0 and empty.columns == ["id"]
    assert durable.release(spark) >= 2 and not any(f.startswith("numbers-") for f in os.listdir(folder))


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"k{i % 97:03d}", i) for i in range(500)], "k string, v long").repartition(7)
    got = numbered(df, ["k", "v"], "id", 11).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.k, r.v))] == list(range(11, 511))
    assert numbered(df.limit(0), ["k"], "id").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (1, None, "z"), (2, None, "d"), (2, None, "d")], "k long, v long, x string")
    assert sorted(map(tuple, latest(df, ["k"], "v", ["x"]).collect())) == [(1, 7, "c"), (2, None, "d")]


def test_spread(spark, sf):
    one = spark.read.parquet(f"{sf}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == one.count()
    many = spark.range(100, numPartitions=cores + 3)
    assert spread(many) is many
    shuffled = one.groupBy("source").count()
    assert spread(shuffled) is shuffled
