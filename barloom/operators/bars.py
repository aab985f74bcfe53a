"""Ticks to bars, bars to coarser bars, and plain bar / quote arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio

# The bucket sizes the bar tables come in.
BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def bucket(time: str | Column, size: str) -> Column:
    """Start of the bucket a time falls in. ``size``: a key of BUCKETS, 'week', or an interval text."""
    c = F.col(time) if isinstance(time, str) else time
    if size in ("week", "month", "quarter", "year"):
        return F.date_trunc(size, c).cast("timestamp_ntz")
    return F.window(c.cast("timestamp"), BUCKETS.get(size, size)).start.cast("timestamp_ntz")


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """The order as one value of fixed width, so that first and last are hash aggregates and no task sorts its ticks.

    A time and a whole number are packed into one decimal. Other orders of several columns stay a struct.
    """
    if len(order) == 1:
        return F.col(order[0])
    kinds = [df.schema[c].dataType.typeName() for c in order]
    if len(order) == 2 and kinds[0] in ("date", "timestamp", "timestamp_ntz") and kinds[1] in ("byte", "short", "integer", "long"):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(19,0)")
        return (micros * F.lit(str(2**64)).cast("decimal(20,0)") + F.col(order[1])).cast("decimal(38,0)")
    return F.struct(*order)


def bars_from_ticks(
    ticks: DataFrame,
    size: str,
    *,
    key: Sequence[str] = ("symbol",),
    time: str = "time",
    order: Sequence[str] = ("time", "seq"),
) -> DataFrame:
    """OHLCV bars of a tick table (price, size), with volume-weighted price and trade count.

    Partial aggregation before the shuffle keeps a hot symbol cheap: what travels is one row per
    (task, symbol, bucket).
    """
    at = order_key(ticks, order)
    value = F.col("price") * F.col("size")
    return (
        ticks.groupBy(*key, bucket(time, size).alias("time"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").cast("long").alias("volume"),
            F.sum(value).alias("_value"),
            F.sum("size").alias("_size"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .withColumn("vwap", ratio(F.col("_value"), F.col("_size")))
        .drop("_value", "_size")
    )


def coarser_bars(bars: DataFrame, size: str, *, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Roll bars up into larger buckets: first open, last close, volume-weighted vwap."""
    return (
        bars.groupBy(*key, bucket("time", size).alias("bucket"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum(F.col("volume") * F.col("vwap")).alias("_value"),
            F.sum("trade_count").alias("trade_count"),
        )
        .withColumn("vwap", ratio(F.col("_value"), F.col("volume")))
        .drop("_value")
        .withColumnRenamed("bucket", "time")
    )


def bar_shape(bars: DataFrame) -> DataFrame:
    """Range, body and direction of each bar."""
    return bars.withColumns(
        {
            "range": F.col("high") - F.col("low"),
            "body": F.abs(F.col("close") - F.col("open")),
            "is_bullish": F.col("close") > F.col("open"),
        }
    )


def quote_shape(quotes: DataFrame) -> DataFrame:
    """Spread and mid price of each quote."""
    return quotes.withColumns(
        {"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2}
    )


def mean_spread(quotes: DataFrame, *, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Average relative bid-ask spread per symbol."""
    q = quote_shape(quotes)
    return q.groupBy(*key).agg(F.avg(ratio(F.col("spread"), F.col("mid"))).alias("avg_spread_pct"))


def dedupe_key(df: DataFrame, key: Sequence[str] = ("symbol", "time"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the first row of every key in the given order."""
    rest = [c for c in df.columns if c not in key]
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*key, *rest)
