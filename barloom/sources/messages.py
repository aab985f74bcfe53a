"""Vendor stream messages, topic messages and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# `c` is a list of conditions in trades and the close in bars: bars are read with their own schema.
BAR = "ev string, sym string, s bigint, o double, h double, l double, c double, v bigint, vw double, n int"
TICK = "ev string, sym string, t bigint, p double, s bigint, x int, c array<int>, bp double, ap double, bs int, `as` int"


def ns_to_timestamp(ns: Column) -> Column:
    """Nanoseconds since the epoch as a timestamp (microseconds; keep the number for the rest)."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def timestamp_to_ns(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) * 1000


def iso_millis(t: Column) -> Column:
    """ISO-8601 text with milliseconds, UTC."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def decode_items(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per message item as JSON text, with its ``ev``; works on batches and streams.

    A message is an object or an array of objects. Items without ``ev`` and text that is not JSON vanish.
    """
    body = F.trim(text)
    wrapped = F.when(F.startswith(body, F.lit("[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    # items stay text until their kind is known
    items = F.from_json(wrapped, "array<string>")
    rest = [c for c in raw.columns if c != text]
    out = raw.select(*rest, F.explode(items).alias("item"))
    return out.withColumn("ev", F.get_json_object("item", "$.ev")).filter(F.col("ev").isNotNull())


def _parsed(items: DataFrame, kinds: list[str], schema: str) -> DataFrame:
    rest = [c for c in items.columns if c not in ("item", "ev")]
    return items.filter(F.col("ev").isin(kinds)).select(*rest, F.from_json("item", schema).alias("m"))


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "m"]


def trades(items: DataFrame, conditions: int | None = None) -> DataFrame:
    """symbol, time, ts_ns, price, size, exchange code and conditions (all, or the first so many)."""
    df = _parsed(items, ["T"], TICK)
    m = lambda n: F.col(f"m.{n}")
    return df.select(
        *_rest(df), m("sym").alias("symbol"), ns_to_timestamp(m("t")).alias("time"), m("t").alias("ts_ns"),
        m("p").alias("price"), m("s").alias("size"), m("x").alias("exchange"), (m("c") if conditions is None else F.slice(m("c"), 1, conditions)).alias("conditions"),
    )


def quotes(items: DataFrame) -> DataFrame:
    df = _parsed(items, ["Q"], TICK)
    m = lambda n: F.col(f"m.{n}")
    return df.select(
        *_rest(df), m("sym").alias("symbol"), ns_to_timestamp(m("t")).alias("time"), m("t").alias("ts_ns"),
        m("bp").alias("bid"), m("ap").alias("ask"), m("bs").alias("bid_size"), m("`as`").alias("ask_size"),
    )


def bars(items: DataFrame) -> DataFrame:
    """Minute and second bars; the start is in milliseconds."""
    df = _parsed(items, ["AM", "A"], BAR)
    m = lambda n: F.col(f"m.{n}")
    return df.select(
        *_rest(df), m("sym").alias("symbol"), F.timestamp_millis(m("s")).alias("time"), (m("s") * 1000000).alias("ts_ns"),
        m("o").alias("open"), m("h").alias("high"), m("l").alias("low"), m("c").alias("close"), m("v").alias("volume"),
        m("vw").alias("vwap"), m("n").alias("trade_count"),
    )


# -- topics --------------------------------------------------------------------------------------

TOPICS = {
    "TRADE": "symbol string, timestamp bigint, price double, size bigint, exchange string",
    "QUOTE": "symbol string, timestamp bigint, bid_price double, ask_price double, bid_size bigint, ask_size bigint",
    "BAR": "symbol string, timestamp bigint, open double, high double, low double, close double, volume bigint, vwap double",
    "SIGNAL": "symbol string, timestamp bigint, signal_type string, strength double, source string",
}


def to_topic(df: DataFrame, topic: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, value, topic: rows as JSON, ready for a message sink. Columns are those of the topic's schema."""
    names = [part.split()[0] for part in TOPICS[topic].split(", ")]
    body = F.to_json(F.struct(*names))
    return df.select(*keep, F.col("symbol").alias("key"), body.alias("value"), F.lit(topic).alias("topic"))


def from_topic(messages: DataFrame, topic: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decoded rows of a topic: missing numbers are 0, missing text empty, a missing signal type HOLD."""
    schema = TOPICS[topic]
    got = messages.filter(F.col("topic") == topic).select(*keep, F.from_json("value", schema).alias("m"))
    cells = []
    for part in schema.split(", "):
        name, kind = part.split()
        default = F.lit("HOLD") if name == "signal_type" else F.lit("" if kind == "string" else 0)
        value = F.coalesce(F.col(f"m.{name}"), default.cast(kind))
        cells.append(ns_to_timestamp(value).alias("time") if name == "timestamp" else value.alias(name))
    return got.filter(F.col("m").isNotNull()).select(*keep, *cells)


def rankings_message(ranked: DataFrame) -> DataFrame:
    """One JSON message per time with the ranked symbols and their factors (at most the top n per time)."""
    entry = F.struct(
        "rank",
        "symbol",
        "composite_score",
        F.struct(
            F.col("momentum_score").alias("momentum"),
            F.col("volume_score").alias("volume"),
            F.col("sentiment_score").alias("sentiment"),
        ).alias("factors"),
    )
    per = ranked.groupBy("time").agg(F.sort_array(F.collect_list(entry)).alias("rankings"))
    stamp = (F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long")
    body = F.to_json(F.struct(F.lit("rankings").alias("type"), stamp.alias("timestamp"), "rankings"))
    return per.select("time", F.lit("RANKINGS").alias("topic"), body.alias("value"))


def signal_message(signals: DataFrame) -> DataFrame:
    """The dashboard's signal message per row."""
    c = F.col
    body = F.to_json(
        F.struct(
            F.lit("signal").alias("type"), "symbol", c("technical_signal").alias("technical"),
            c("prediction_signal").alias("prediction"), c("sentiment_signal").alias("sentiment"),
            c("composite_signal").alias("composite"), "confidence", "position_size", "action", "stop_loss", "take_profit",
            "expected_return",
        )
    )
    return signals.select("symbol", "time", F.lit("SIGNAL").alias("topic"), body.alias("value"))


def alert_message(df: DataFrame, message: Column, severity: Column) -> DataFrame:
    stamp = (F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long")
    body = F.to_json(
        F.struct(F.lit("alert").alias("type"), message.alias("message"), severity.alias("severity"), stamp.alias("timestamp"))
    )
    return df.select("time", F.lit("ALERT").alias("topic"), body.alias("value"))


# -- audit ---------------------------------------------------------------------------------------


def audit_signals(signals: DataFrame) -> DataFrame:
    """Audit rows of signals."""
    details = F.to_json(F.struct(F.col("composite_signal").alias("composite"), "action", "confidence"))
    return signals.select("time", F.lit("SIGNAL").alias("event_type"), "symbol", details.alias("details"))


def audit_orders(orders: DataFrame) -> DataFrame:
    """Audit rows of orders; the decision is APPROVED, or the reason of the rejection."""
    decision = F.coalesce("reason", F.lit("APPROVED")).alias("decision")
    details = F.to_json(F.struct("side", "quantity", "price", decision))
    return orders.select("time", F.lit("ORDER").alias("event_type"), "symbol", details.alias("details"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to the log, one folder per day."""
    rows.withColumn("day", F.to_date("time")).write.mode("append").partitionBy("day").json(path)
