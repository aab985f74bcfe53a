"""Bars, latest rows, quotes, retention and load queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import latest as L
from barloom.plans import views as V
from barloom.plans.registry import final, query

BAR = "open high low close vwap"


@query(final(f"(WITH {V.WEEKLY} SELECT * FROM bars)", BAR))
def bars_weekly(spark, sf):
    """Weekly OHLCV bars from trades."""
    return V.weekly_bars(spark, sf)


@query(final(f"(WITH {V.DAILY} SELECT * FROM bars)", BAR))
def bars_daily(spark, sf):
    """Daily OHLCV bars from trades."""
    return V.daily_bars(spark, sf)


def _tick_bars(unit):
    return f"""minute_bars AS (
      SELECT symbol, {unit} AS time, arg_min(price, (time, seq)) AS open, max(price) AS high,
             min(price) AS low, arg_max(price, (time, seq)) AS close, CAST(sum(size) AS BIGINT) AS volume,
             count(*) AS trade_count, sum(price * size) / sum(size) AS vwap
      FROM ticks GROUP BY 1, 2)"""


MINUTES = _tick_bars("date_trunc('minute', time)")
FIVE = _tick_bars("time_bucket(INTERVAL '5 minutes', time)")


@query(final(f"(WITH {V.TICKS}, {MINUTES} SELECT * FROM minute_bars)", BAR))
def bars_minute(spark, sf):
    """One-minute bars from trades."""
    return B.bars_from_ticks(V.event_ticks(spark, sf), "1m")


@query(final(f"(WITH {V.TICKS}, {FIVE} SELECT * FROM minute_bars)", BAR))
def bars_five_minutes(spark, sf):
    """Five-minute bars from trades."""
    return B.bars_from_ticks(V.event_ticks(spark, sf), "5m")


@query(
    final(
        f"""(WITH {V.TICKS}, {MINUTES}
        SELECT symbol, date_trunc('hour', time) AS time, first(open ORDER BY time) AS open,
               max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close,
               CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
               sum(volume * vwap) / nullif(sum(volume), 0) AS vwap
        FROM minute_bars GROUP BY 1, 2)""",
        BAR,
    )
)
def bars_hourly_vwap(spark, sf):
    """Hourly bars rolled up from one-minute bars."""
    return B.coarser_bars(B.bars_from_ticks(V.event_ticks(spark, sf), "1m"), "1h")


@query(
    final(
        f"""(WITH {V.WEEKLY} SELECT symbol, time, high - low AS "range", abs(close - open) AS body,
        close > open AS is_bullish FROM bars)""",
        '"range" body',
    )
)
def bar_shapes(spark, sf):
    """Range, body and direction of bars."""
    return B.bar_shape(V.weekly_bars(spark, sf)).select("symbol", "time", "range", "body", "is_bullish")


@query(
    final(
        f"""(WITH {V.TICKS}, {V.QUOTES} SELECT seq, symbol, ask - bid AS spread, (ask + bid) / 2 AS mid
        FROM quotes)""",
        "spread mid",
    )
)
def quote_shapes(spark, sf):
    """Spread and mid of quotes."""
    return B.quote_shape(V.event_quotes(spark, sf)).select("seq", "symbol", "spread", "mid")


@query(
    final(
        f"""(WITH {V.TICKS}, {V.QUOTES} SELECT symbol,
        avg((ask - bid) / ((ask + bid) / 2)) AS avg_spread_pct FROM quotes GROUP BY 1)""",
        "avg_spread_pct",
    )
)
def average_spread(spark, sf):
    """Mean relative spread per symbol."""
    return B.mean_spread(V.event_quotes(spark, sf))


@query(
    final(
        """(SELECT symbol, time, arg_min(price, seq) AS price, arg_min(size, seq) AS size, min(seq) AS seq FROM (
        SELECT concat('U', user_id) AS symbol, date_trunc('hour', ts) AS time, event_id AS seq,
               value + 100 AS price, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS size FROM events)
        GROUP BY 1, 2)""",
        "price",
    )
)
def keyed_first_tick(spark, sf):
    """Key (symbol, time) enforced: the first row of a key stays."""
    ticks = V.event_ticks(spark, sf).withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return B.dedupe_key(ticks.select("symbol", "time", "seq", "price", "size"))


@query(final(f"(WITH {V.WEEKLY} SELECT symbol, arg_max(close, time) AS close FROM bars GROUP BY 1)", "close"))
def latest_price(spark, sf):
    """Last close per symbol."""
    return L.latest_price(V.weekly_bars(spark, sf))


@query(
    final(
        f"""(WITH {V.WEEKLY} SELECT symbol, time, close, rn::INTEGER AS age FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars) WHERE rn <= 500)""",
        "close",
    )
)
def latest_n_bars(spark, sf):
    """The last 500 bars of each symbol."""
    return L.last_n(V.weekly_bars(spark, sf), 500, order=("time",)).select("symbol", "time", "close", "age")


@query(
    final(
        f"""(WITH {V.TICKS} SELECT symbol, time, seq, price, size, rn::INTEGER AS age FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC, seq DESC) AS rn FROM ticks)
        WHERE rn <= 100)""",
        "price",
    )
)
def latest_trades(spark, sf):
    """The last 100 trades of each symbol."""
    ticks = V.event_ticks(spark, sf)
    return L.last_n(ticks, 100).select("symbol", "time", "seq", "price", "size", "age")


@query(
    final(
        f"""(WITH {V.TICKS}, {V.QUOTES} SELECT symbol, max(seq) AS seq, arg_max(bid, (time, seq)) AS bid,
        arg_max(ask, (time, seq)) AS ask FROM quotes GROUP BY 1)""",
        "bid ask",
    )
)
def latest_quote(spark, sf):
    """Newest quote of each symbol."""
    return L.latest_row(V.event_quotes(spark, sf)).select("symbol", "seq", "bid", "ask")


@query(f"WITH {V.WEEKLY}, {V.TICKS} SELECT symbol FROM bars UNION SELECT symbol FROM ticks")
def tracked_symbols(spark, sf):
    """Symbols seen in bars or quotes."""
    return L.tracked_symbols(V.weekly_bars(spark, sf), V.event_quotes(spark, sf))


@query(
    f"""WITH {V.TICKS}, edge AS (SELECT max(time) AS as_of FROM ticks)
    SELECT seq, symbol, time FROM ticks, edge WHERE time >= as_of - INTERVAL '7 days'"""
)
def retention_filter(spark, sf):
    """Ticks inside the seven-day retention, as of the newest tick."""
    return L.retain(V.event_ticks(spark, sf), "market_ticks").select("seq", "symbol", "time")


@query(f"""WITH {V.WEEKLY} SELECT symbol, time, volume FROM bars WHERE symbol IN ('NATION_3', 'NATION_7', 'NOWHERE')
    AND time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def bars_range_scan(spark, sf):
    """Bars of some symbols in a date range; missing symbols are skipped."""
    bars = V.weekly_bars(spark, sf)
    out = L.range_scan(bars, ["NATION_3", "NATION_7", "NOWHERE"], "1996-01-01", "1996-12-31")
    return out.select("symbol", "time", "volume")


@query(f"""WITH {V.WEEKLY} SELECT symbol, min(time) AS first_time, max(time) AS last_time, count(*) AS n_rows,
    date_diff('day', max(time), (SELECT max(l_shipdate) FROM lineitem)) > 30 AS delisted FROM bars GROUP BY 1""")
def history_span(spark, sf):
    """First and last bar, bar count and the no-recent-data flag per symbol."""
    as_of = V.table(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("as_of"))
    return L.history_span(V.weekly_bars(spark, sf), as_of)


@query(f"""WITH {V.WEEKLY}, n AS (SELECT symbol, count(*) AS c FROM bars GROUP BY 1)
    SELECT symbol, time, volume FROM bars JOIN n USING (symbol) WHERE c >= 300""")
def minimum_history(spark, sf):
    """Bars of symbols with at least 300 bars."""
    return L.with_history(V.weekly_bars(spark, sf), 300).select("symbol", "time", "volume")
