"""Structured Streaming twins of the batch operators.

Keyed results go to a ``KeyedStore``: every micro-batch overwrites its own folder, so a repeated batch changes nothing, a
reader takes the newest revision of each key, and revisions are merged into generations as they add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.functions.positions import number_sorted
from barloom.functions.series import Series
from barloom.operators.bars import order_key
from barloom.operators.halts import HALT, STATE, halt_changes
from barloom.operators.latest import last_n
from barloom.sources import messages
from barloom.sources.keyed_store import KeyedStore, Snapshots

#: How far behind stream state is kept where a job is asked to drop it: as far as the hourly bars are refreshed.
LATE = "3 hours"


def event_time(df: DataFrame, time: str = "time") -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


# -- running and sinks ---------------------------------------------------------------------------


def revisions(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), *, mode: str = "update", every: str | None = None, merge: int = 16):
    """Write a keyed stream as revisions. Without ``every`` it takes what is there and stops.

    With ``keys`` the revisions are merged after ``merge`` micro-batches; without, all of them stay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(batch.sparkSession, path, keys, merge).write(batch, batch_id)

    return _start(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, every)


def _start(writer, checkpoint: str, every: str | None):
    writer = writer.option("checkpointLocation", checkpoint)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest revision of every key."""
    rows = KeyedStore(spark, path, keys).read()
    if rows is None:
        raise ValueError(f"nothing has been written to {path} yet")
    return rows


# -- bars ----------------------------------------------------------------------------------------


def _watermarked(df: DataFrame, late: str | None) -> DataFrame:
    out = event_time(df)
    return out if late is None else out.withWatermark("time", late)


def bars(ticks: DataFrame, size: str = "1 hour", late: str | None = None, order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """Tick stream to bars. Every tick revises its bar, however late; the state is one row per bar.

    With ``late`` (``LATE`` is the usual bound) older state is dropped, and so are ticks further behind than that: then
    the result depends on how the ticks are cut into micro-batches.
    """
    ticks = _watermarked(ticks, late)
    at = order_key(ticks, order)
    value = F.col("price") * F.col("size")
    return (
        ticks.groupBy("symbol", F.window("time", size).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").cast("long").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
            F.sum(value).alias("_value"),
            F.sum("size").alias("_size"),
        )
        .select(
            "symbol", F.col("w.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume",
            "trade_count", ratio(F.col("_value"), F.col("_size")).alias("vwap"),
        )
    )


def coarser_bars(small: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Continuous roll-up of small bars into larger ones; ``late`` as for ``bars``."""
    return (
        _watermarked(small, late)
        .groupBy("symbol", F.window("time", size).alias("w"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("trade_count").alias("trade_count"),
            F.sum(F.col("volume") * F.col("vwap")).alias("_value"),
        )
        .select(
            "symbol", F.col("w.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume",
            "trade_count", ratio(F.col("_value"), F.col("volume")).alias("vwap"),
        )
    )


def sliding_factors(ticks: DataFrame, span: str = "5 minutes", slide: str = "1 minute", late: str | None = None) -> DataFrame:
    """Factor inputs over a sliding span (batch, or a stream where ``late`` is given)."""
    t = event_time(ticks)
    if late is not None:
        t = t.withWatermark("time", late)
    return (
        t.groupBy("symbol", F.window("time", span, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price"), F.sum("size").cast("long").alias("volume"))
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("time"), "n", "avg_price", "volume")
    )


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Newest quote of every symbol as a running aggregate (partial maxima before the shuffle)."""
    at = order_key(quotes, ("time", "seq"))
    return quotes.groupBy("symbol").agg(*(F.max_by(c, at).alias(c) for c in ("time", "seq", "bid", "ask")))


# -- kept rows per symbol --------------------------------------------------------------------------
# A symbol's rows of one micro-batch would all meet in one task in a keyed-state operator. These jobs
# keep the state as a small table instead (the last rows of every symbol, replaced by every micro-batch)
# and run the block windows and per-task limits of the batch operators on it.


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def score_histories(
    stream: DataFrame, make_score: Callable[[], Callable[[pd.DataFrame], float]], out: str, checkpoint: str,
    columns: Sequence[str] = ("close",), keep: int = 110, ready: int = 80, every: str | None = None,
):
    """Score every new bar (symbol, time, seq, columns) against the symbol's last ``keep`` bars up to it.

    A late bar takes its place in time; one older than all kept bars of a full history cannot be scored and goes to
    ``out``/late.
    Writes symbol, time, seq, n_bars, ready, score (null before ``ready`` bars are there) below ``out``,
    and the kept bars of every symbol as its state.
    """
    names = list(columns)

    @F.pandas_udf("double")
    def score(histories: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rate = make_score()
        for h in histories:
            yield h.map(lambda x: None if x is None else rate(pd.DataFrame(list(x), columns=names))).astype("float64")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        new = batch.select("symbol", "time", "seq", *(F.col(n).cast("double") for n in names))
        kept = Snapshots(spark, f"{out}/kept")
        old = kept.before(batch_id, _ddl(new))
        edge = old.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.struct("time", "seq")).alias("_oldest")
        )
        late = (F.col("_n") >= keep) & (F.struct("time", "seq") < F.col("_oldest"))
        dated = new.join(edge, "symbol", "left").withColumn("_late", F.coalesce(late, F.lit(False))).drop("_n", "_oldest")
        dated.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/_batch={batch_id}")
        new = dated.filter("NOT _late").drop("_late")
        both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        s = Series.of(number_sorted(both, ["symbol"], ["time", "seq"]), behind=keep)
        s = s.with_columns(_h=F.collect_list(F.struct(*names)).over(s.rows(keep)))
        rows = s.own(keep_t=False).filter("_new").withColumn("n_bars", F.size("_h")).withColumn("ready", F.col("n_bars") >= ready)
        rows = rows.withColumn("score", score(F.when(F.col("ready"), F.col("_h"))))
        done = rows.select("symbol", "time", "seq", "n_bars", "ready", "score")
        done.write.mode("overwrite").parquet(f"{out}/scores/_batch={batch_id}")
        kept.write(last_n(both.drop("_new"), keep).drop("age"), batch_id)
        batch.unpersist()

    return _start(stream.writeStream.foreachBatch(step), checkpoint, every)


def scores(spark: SparkSession, out: str) -> DataFrame:
    """What ``score_histories`` has written."""
    return spark.read.parquet(f"{out}/scores").drop("_batch")


def last_trades(stream: DataFrame, out: str, checkpoint: str, n: int = 100, every: str | None = None):
    """Keep every symbol's newest n rows (by time, seq) in a table below ``out``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = Snapshots(batch.sparkSession, out)
        kept.write(last_n(kept.before(batch_id, _ddl(batch)).unionByName(batch), n).drop("age"), batch_id)

    return _start(stream.writeStream.foreachBatch(step), checkpoint, every)


def newest_trades(spark: SparkSession, out: str, n: int = 100) -> DataFrame:
    """The table of ``last_trades`` after its newest micro-batch, with the age of each row."""
    rows = Snapshots(spark, out).read()
    if rows is None:
        raise ValueError(f"nothing has been written to {out} yet")
    return last_n(rows, n)


# -- trading halts ---------------------------------------------------------------------------------


def halt_intervals(stream: DataFrame, out: str, checkpoint: str, failures: int = HALT["failures"], cooldown: int = HALT["cooldown"], every: str | None = None):
    """Trading halts of an outcome stream (symbol, time, seq, ok), see ``operators.halts``.

    A micro-batch is folded in parallel, from the state that the one before left (one row per symbol). Its changes go to
    a folder of its own below ``out``, so a repeated batch changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        states = Snapshots(batch.sparkSession, f"{out}/state")
        changes, after = halt_changes(batch, states.before(batch_id, STATE), failures, cooldown)
        KeyedStore(batch.sparkSession, f"{out}/changes").write(changes, batch_id)
        states.write(after, batch_id)

    return _start(stream.writeStream.foreachBatch(step), checkpoint, every)


def halts(spark: SparkSession, out: str) -> DataFrame:
    """The state changes that ``halt_intervals`` has written."""
    return KeyedStore(spark, f"{out}/changes").revisions().drop("_batch")


# -- messages and articles -----------------------------------------------------------------------


def dispatch(raw: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None):
    """Send decoded trades, quotes and bars of a message stream to their handlers, once per micro-batch.

    ``handlers``: any of trade, quote, bar -> function of (batch, batch id).
    """
    readers = {"trade": messages.trades, "quote": messages.quotes, "bar": messages.bars}
    items = messages.decode_items(raw)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind, handler in handlers.items():
            handler(readers[kind](batch), batch_id)
        batch.unpersist()

    return _start(items.writeStream.foreachBatch(handle), checkpoint, every)


def articles(
    docs: DataFrame, symbols: Column, score: Callable[[DataFrame], DataFrame], store: str, checkpoint: str,
    publish: Callable[[DataFrame, int], None] | None = None, every: str | None = None, merge: int = 16,
) -> object:
    """Article stream: score the text, one row per mentioned symbol, keyed store, then publish.

    ``symbols`` is an array column; ``score`` adds sentiment and confidence. The store is keyed by (article_id, symbol): a
    repeated article replaces its rows, and revisions are merged after ``merge`` micro-batches.
    """
    rows = score(docs).withColumn("symbol", F.explode(F.array_distinct(symbols)))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        KeyedStore(batch.sparkSession, store, ["article_id", "symbol"], merge).write(batch, batch_id)
        if publish is not None:
            publish(batch, batch_id)
        batch.unpersist()

    return _start(rows.writeStream.foreachBatch(write), checkpoint, every)


def audit(signals: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append an audit row per signal."""
    rows = messages.audit_signals(signals).withColumn("day", F.to_date("time"))
    writer = rows.writeStream.outputMode("append").format("json").partitionBy("day").option("path", path)
    return _start(writer, checkpoint, every)
