"""Latest rows, last-n rows, range scans, history length and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many days each table is kept.
RETENTION_DAYS = {
    "market_ticks": 7,
    "ohlcv_1m": 30,
    "ohlcv_5m": 90,
    "news_sentiment": 90,
    "audit_log": 365,
}


def latest_price(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    """Last close per symbol, or of one symbol. A pre-aggregated maximum, no sort."""
    if symbol is not None:
        bars = bars.filter(F.col("symbol") == symbol)
    return bars.groupBy("symbol").agg(F.max_by("close", "time").alias("close"))


def latest_row(df: DataFrame, *, key: Sequence[str] = ("symbol",), order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """The newest row per key."""
    rest = [c for c in df.columns if c not in key]
    return last_n(df, 1, key=key, order=order).select(*key, *rest)


def latest_signal(signals: DataFrame, symbol: str) -> DataFrame:
    """Newest signal of one symbol (of one time the strongest): time, composite_signal, action, confidence."""
    mine = signals.filter(F.col("symbol") == symbol)
    return mine.orderBy(F.desc("time"), F.desc("composite_signal"), F.desc("confidence"), "action").limit(1).select("time", "composite_signal", "action", "confidence")


def last_n(
    df: DataFrame, n: int, *, key: Sequence[str] = ("symbol",), order: Sequence[str] = ("time", "seq")
) -> DataFrame:
    """The newest n rows per key with their age (1 = newest).

    Spark limits each key to n rows in every task before the shuffle, so a hot key does not pile up.
    """
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def tracked_symbols(*frames: DataFrame) -> DataFrame:
    """Distinct symbols over several tables."""
    out = frames[0].select("symbol").distinct()
    for f in frames[1:]:
        out = out.union(f.select("symbol").distinct())
    return out.distinct()


def range_scan(df: DataFrame, symbols: Sequence[str], start: str, end: str, time: str = "time") -> DataFrame:
    """Rows of the given symbols between two times (inclusive)."""
    t = F.col(time)
    inside = t.between(F.lit(start).cast(df.schema[time].dataType), F.lit(end).cast(df.schema[time].dataType))
    return df.filter(F.col("symbol").isin(list(symbols)) & inside)


def history_span(bars: DataFrame, as_of: DataFrame, idle_days: int = 30) -> DataFrame:
    """First and last time, row count, and whether the last bar is older than ``idle_days``.

    ``as_of`` is a one-row frame with the reference time.
    """
    spans = bars.groupBy("symbol").agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    now = as_of.agg(F.max("as_of").alias("as_of")).scalar()
    return spans.withColumn("delisted", F.datediff(now, F.col("last_time")) > idle_days)


def with_history(df: DataFrame, n: int) -> DataFrame:
    """Rows of the symbols that have at least n rows."""
    enough = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(enough.select("symbol"), "symbol", "left_semi")


def retain(df: DataFrame, policy: str, time: str = "time", as_of: str | None = None) -> DataFrame:
    """Rows younger than the retention of ``policy``, counted from ``as_of`` or the newest row."""
    keep = F.make_dt_interval(days=F.lit(RETENTION_DAYS[policy]))
    if as_of is not None:
        return df.filter(F.col(time) >= F.lit(as_of).cast(df.schema[time].dataType) - keep)
    edge = df.agg((F.max(time) - keep).alias("edge")).scalar()
    return df.filter(F.col(time) >= edge)
