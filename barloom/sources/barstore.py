"""Stored bars: layers by preference, tiers as partitions, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.messages import ns_to_timestamp

# Names that are not symbols.
NOT_SYMBOLS = ("market_context", "processing_summary")


def write_bars(bars: DataFrame, path: str, *, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Bars as Parquet, sorted by symbol and time inside each file, so that row groups can be skipped."""
    out = bars.sortWithinPartitions(*by, "symbol", "time").write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Parquet bars, also as pandas writes them (nanosecond times, which Spark reads as numbers)."""
    option = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(option)
    spark.conf.set(option, "true")  # only while the schema is read
    try:
        return spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(path)
    finally:
        spark.conf.set(option, before)


def load_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, tier: str | None = None) -> DataFrame:
    """Bars of some symbols or of one tier (a pruned partition). Symbols that do not exist are skipped."""
    df = lower_names(read_files(spark, path))
    if tier is not None:
        df = df.filter(F.col("tier") == tier)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    return df


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case column names; a date or timestamp column becomes ``time``, numbers of nanoseconds a time."""
    df = df.toDF(*(c.lower() for c in df.columns))
    found = [c for c in ("time", "date", "timestamp") if c in df.columns]
    if not found:
        return df
    df = df.withColumnRenamed(found[0], "time")
    if dict(df.dtypes)["time"] == "bigint":
        df = df.withColumn("time", ns_to_timestamp(F.col("time")).cast("timestamp_ntz"))
    return df


def preferred(layers: Sequence[DataFrame]) -> DataFrame:
    """For every symbol the rows of the first layer that has it (enhanced, historical, daily)."""
    both = None
    for rank, layer in enumerate(layers):
        tagged = lower_names(layer).withColumn("_layer", F.lit(rank))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    best = both.groupBy("symbol").agg(F.min("_layer").alias("_layer"))
    return both.join(best, ["symbol", "_layer"], "left_semi").drop("_layer")


def symbols(df: DataFrame) -> DataFrame:
    """Distinct symbols, without the names of helper files."""
    return df.filter(~F.col("symbol").isin(list(NOT_SYMBOLS))).select("symbol").distinct()


def symbols_of_files(spark: SparkSession, path: str, suffix: str = "_[a-z]+") -> DataFrame:
    """Distinct symbols of a one-file-per-symbol layout, from the file names."""
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^([^.]+?){suffix}\.parquet$", 1)
    df = read_files(spark, path, recursive=True).select(name.alias("symbol"))
    return symbols(df.filter(F.col("symbol") != ""))


def write_manifest(tier_counts: DataFrame, tier_symbols: DataFrame, path: str) -> None:
    """Counts as JSON and CSV, symbols as one text list per tier."""
    tier_counts.write.mode("overwrite").json(f"{path}/counts")
    tier_counts.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    listed = tier_symbols.select("tier", "symbol").sortWithinPartitions("tier", "symbol")
    listed.write.mode("overwrite").partitionBy("tier").text(f"{path}/symbols")


def load_delisted(spark: SparkSession, prices_path: str, labels_path: str | None = None) -> DataFrame:
    """Delisted prices with their labels where there are any."""
    prices = lower_names(read_files(spark, prices_path))
    if labels_path is None:
        return prices
    labels = lower_names(read_files(spark, labels_path))
    return prices.join(labels, ["symbol", "time"], "left")
