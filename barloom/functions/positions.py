"""Positions of rows within their key where one key, or one moment of it, may hold any share of the table.

Rows are sorted by (key, order) over range partitions of about equal size: Spark draws the borders from the data, so a hot key, or a
hot hour of it, is cut into as many partitions as it needs. A row's place in its partition and the number of rows that
its key has in earlier partitions give its position; only these counts, one row per key and partition, are added up per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import group_of
from barloom.sources.stage import stage

#: Rows of a range partition, about.
RUN = 100_000
_PART = 1 << 33  # Spark's row ids: the partition in the bits above, the place in it below


def sorted_runs(df: DataFrame, key: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows written in order of (key, order) with ``_run``, the partition, and ``_place``, the place in it.

    Nulls come first. Rows that tie in the whole order may stand either way, but always the same way in the written
    table.
    """
    by = [*key, *order]
    if parts is None:
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RUN))
    cut = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return stage(cut.withColumn("_id", F.monotonically_increasing_id()), "runs").select(
        *df.columns, F.floor(F.col("_id") / _PART).alias("_run"), (F.col("_id") % _PART).alias("_place")
    )


def number_sorted(df: DataFrame, key: Sequence[str] = ("symbol",), order: Sequence[str] = ("time",), parts: int | None = None) -> DataFrame:
    """Add ``_t``, the 0-based position within the key. No window runs on the rows of a key."""
    runs = sorted_runs(df, key, order, parts).withColumn("_key", group_of(key))
    counts = runs.groupBy("_key", "_run").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_key", "_run", "_start", "_first")
    placed = runs.join(starts, ["_key", "_run"]).withColumn("_t", F.col("_start") + F.col("_place") - F.col("_first"))
    return placed.select(*df.columns, "_t")
