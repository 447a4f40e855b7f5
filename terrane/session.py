"""Session defaults. Library code never creates a session of its own; tests, the bench and the CLI do."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it is not installed, by the folder that it was imported from.

    On a cluster whose executors don't see that folder, give the package to ``--py-files`` instead.
    """
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [folder, known]))
    return spark


def local_session(cpus: int | str | None = None, app: str = "terrane", **conf: str) -> SparkSession:
    """A local session with the settings this engine expects: AQE, Arrow, UTC, few shuffle partitions."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TERRANE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return share_package(spark)
