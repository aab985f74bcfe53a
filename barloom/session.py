"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call sites on every column expression: building wide plans takes half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
