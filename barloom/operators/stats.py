"""Normalisation statistics, z-scores, column quality and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: a struct (mean, std) per column, sample deviation."""
    return df.agg(
        *(F.struct(F.avg(n).alias("mean"), F.stddev_samp(n).alias("std")).alias(n) for n in names)
    )


def apply_stats(df: DataFrame, stats: DataFrame, names: Sequence[str], style: str = "train") -> DataFrame:
    """Z-scores by the given statistics, read as a scalar subquery (one row, no join).

    ``train``: a column without spread becomes 0. ``live``: a spread below 1e-8 counts as 1.
    Columns without statistics stay as they are.
    """
    known = [n for n in names if n in stats.columns]
    row = stats.select(F.struct(*known).alias("s")).scalar()
    out = df.withColumn("_stats", row)
    cells = {}
    for n in known:
        mean, std = F.col(f"_stats.{n}.mean"), F.col(f"_stats.{n}.std")
        if style == "live":
            cells[n] = (F.col(n) - mean) / F.when(std < 1e-8, 1.0).otherwise(std)
        else:
            cells[n] = F.when(std > 0, (F.col(n) - mean) / std).otherwise(0.0)
    return out.withColumns(cells).drop("_stats")


def stats_long(df: DataFrame, names: Sequence[str], weight: Column | None = None) -> DataFrame:
    """feature, mean, std over all rows: population deviation + 1e-8, nulls and NaN ignored.

    With ``weight``, every row counts that often (the number of windows it is in). All columns are
    aggregated side by side in one pass; weighted deviations take a second one around the means.
    """
    x = {n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in names}
    if weight is None:
        cells = [
            F.struct(F.lit(n).alias("feature"), F.avg(x[n]).alias("mean"), (F.stddev_pop(x[n]) + 1e-8).alias("std"))
            for n in names
        ]
        wide = df.agg(*(c.alias(n) for n, c in zip(names, cells, strict=True)))
        return wide.select(F.explode(F.array(*names)).alias("c")).select("c.*")
    w = {n: F.when(x[n].isNotNull(), weight.cast("double")) for n in names}
    means = df.agg(*((F.sum(w[n] * x[n]) / F.sum(w[n])).alias(n) for n in names))
    mean = means.select(F.struct(*names).alias("m")).scalar()
    around = df.withColumn("_m", mean)
    wide = around.agg(
        *(
            F.struct(
                F.lit(n).alias("feature"),
                F.first(F.col(f"_m.{n}")).alias("mean"),
                (F.sqrt(F.sum(w[n] * F.pow(x[n] - F.col(f"_m.{n}"), 2)) / F.sum(w[n])) + 1e-8).alias("std"),
            ).alias(n)
            for n in names
        )
    )
    return wide.select(F.explode(F.array(*names)).alias("c")).select("c.*")


def _cells(df: DataFrame, names: Sequence[str]) -> Column:
    return F.array(
        *(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names)
    )


def null_share(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of nulls (in percent) per column with OK / WARN / ERROR at 5 and 20 percent."""
    # one pass over the table, then one row is turned into one row per column
    wide = df.agg(*((F.avg(F.col(n).isNull().cast("double")) * 100).alias(n) for n in names))
    long = wide.select(F.explode(_cells(wide, names)).alias("c")).select(
        F.col("c.feature").alias("column_name"), F.col("c.value").alias("null_pct")
    )
    grade = F.when(F.col("null_pct") < 5, "OK").when(F.col("null_pct") < 20, "WARN").otherwise("ERROR")
    return long.withColumn("status", grade)


def summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """mean, std, min, max per column."""
    cells = []
    for n in names:
        x = F.col(n).cast("double")
        cells.append(
            F.struct(
                F.lit(n).alias("feature"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            ).alias(n)
        )
    wide = df.agg(*cells)
    return wide.select(F.explode(F.array(*names)).alias("c")).select("c.*")


def status_summary(runs: DataFrame) -> DataFrame:
    """Runs per status with mean rows, columns and null percentage."""
    return runs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rows").alias("mean_rows"),
        F.avg("cols").alias("mean_cols"),
        F.avg("null_pct").alias("mean_null_pct"),
    )


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def positive_share(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Percent of ones per label column."""
    wide = df.agg(*((F.avg(n) * 100).alias(n) for n in names))
    return wide.select(F.explode(_cells(wide, names)).alias("c")).select(
        F.col("c.feature").alias("label"), F.col("c.value").alias("positive_pct")
    )
