"""Technical indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import latest as L
from barloom.operators import technical as T
from barloom.plans import views as V
from barloom.plans.registry import final, query
from barloom.plans.sqltext import W, b, chg, cum, div, ewm, lag, over, roll, span

K = "symbol, time"

SMA = f"""
  SELECT {K}, close, {chg('close')} AS returns, ln(close / {lag('close')}) AS log_returns,
  {', '.join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 50, 200))},
  {roll('stddev_samp', 'close', 20)} AS bb_std FROM bars"""


@query(
    final(
        f"""(WITH {V.WEEKLY}, a AS ({SMA}), u AS (SELECT *, sma_20 AS bb_middle, sma_20 + 2 * bb_std AS bb_upper,
        sma_20 - 2 * bb_std AS bb_lower FROM a)
        SELECT {K}, returns, log_returns, sma_5, sma_10, sma_20, sma_50, sma_200, bb_std, bb_middle, bb_upper,
        bb_lower, {div('close', 'sma_20')} AS price_sma_20_ratio, {div('close', 'sma_50')} AS price_sma_50_ratio,
        {div('bb_upper - bb_lower', 'bb_middle')} AS bb_width,
        {div('close - bb_lower', 'bb_upper - bb_lower')} AS bb_position FROM u)""",
        "returns log_returns sma_5 sma_10 sma_20 sma_50 sma_200 bb_std bb_middle bb_upper bb_lower "
        "price_sma_20_ratio price_sma_50_ratio bb_width bb_position",
    )
)
def technical_sma_bollinger(spark, sf):
    """Returns, moving averages, Bollinger bands."""
    df = T.add_technical(V.weekly_layer(spark, sf), ema=False)
    return df.select(
        "symbol", "time", "returns", "log_returns", "sma_5", "sma_10", "sma_20", "sma_50", "sma_200", "bb_std",
        "bb_middle", "bb_upper", "bb_lower", "price_sma_20_ratio", "price_sma_50_ratio", "bb_width", "bb_position",
    )


@query(
    final(
        f"""(WITH {V.WEEKLY}, a AS (SELECT *, close - {lag('close')} AS d, {lag('close')} AS pc,
        {chg('close')} AS r FROM bars),
        g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss,
              greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM a),
        m AS (SELECT {K}, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al,
              {roll('avg', 'tr', 14)} AS atr_14, {roll('stddev_samp', 'r', 20)} * sqrt(252) AS volatility_20 FROM g)
        SELECT {K}, CASE WHEN al = 0 AND ag = 0 THEN NULL WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END
        AS rsi_14, atr_14, volatility_20 FROM m)""",
        "rsi_14 atr_14 volatility_20",
    )
)
def technical_rsi_atr(spark, sf):
    """RSI, ATR and annualised volatility."""
    df = T.add_technical(V.weekly_layer(spark, sf), ema=False)
    return df.select("symbol", "time", "rsi_14", "atr_14", "volatility_20")


@query(
    final(
        f"""(WITH {V.WEEKLY}, a AS (SELECT *, {roll('avg', 'volume', 20)} AS volume_sma_20,
          {roll('max', 'high', 20)} AS high_20, {roll('min', 'low', 20)} AS low_20,
          {', '.join(f"{chg('close', n)} AS momentum_{n}" for n in (1, 5, 10, 20))},
          ({div('open', lag('close'))}) - 1 AS gap FROM bars)
        SELECT {K}, volume_sma_20, {div('volume', 'volume_sma_20')} AS volume_ratio, momentum_1, momentum_5,
        momentum_10, momentum_20, (high - low) / close AS daily_range, high_20, low_20,
        {div('close - low_20', 'high_20 - low_20')} AS position_in_range, gap FROM a)""",
        "volume_sma_20 volume_ratio momentum_1 momentum_5 momentum_10 momentum_20 daily_range high_20 low_20 "
        "position_in_range gap",
    )
)
def technical_momentum_range(spark, sf):
    """Volume ratio, momentum, ranges and gaps."""
    df = T.add_technical(V.weekly_layer(spark, sf), ema=False)
    return df.select(
        "symbol", "time", "volume_sma_20", "volume_ratio", "momentum_1", "momentum_5", "momentum_10", "momentum_20",
        "daily_range", "high_20", "low_20", "position_in_range", "gap",
    )


@query(
    final(
        f"""(WITH {V.WEEKLY}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS t FROM bars),
        e AS (SELECT {K}, t, {', '.join(f"{span('close', n)} AS ema_{n}" for n in (5, 10, 20, 50, 200, 12, 26))} FROM n),
        m AS (SELECT *, ema_12 - ema_26 AS macd FROM e), s AS (SELECT *, {span('macd', 9)} AS macd_signal FROM m)
        SELECT {K}, ema_5, ema_10, ema_20, ema_50, ema_200, macd, macd_signal, macd - macd_signal AS macd_histogram
        FROM s)""",
        "ema_5 ema_10 ema_20 ema_50 ema_200 macd macd_signal macd_histogram",
    )
)
def technical_ema_macd(spark, sf):
    """Exponential averages and MACD."""
    df = T.add_exponential(V.weekly_layer(spark, sf))
    return df.select(
        "symbol", "time", "ema_5", "ema_10", "ema_20", "ema_50", "ema_200", "macd", "macd_signal", "macd_histogram"
    )


@query(
    final(
        f"""(WITH {V.DAILY}, a AS (SELECT *, {roll('avg', 'close', 200)} AS sma_200,
        {chg('close', 20)} AS momentum, row_number() OVER ({W}) - 1 AS days_listed FROM bars)
        SELECT {K}, CASE WHEN close > sma_200 THEN 1 ELSE -1 END AS trend, momentum, days_listed FROM a)""",
        "momentum",
    )
)
def trend_days_listed(spark, sf):
    """Trend flag, 20-row momentum and row counter on daily bars (several blocks per symbol)."""
    return T.add_trend(V.daily_layer(spark, sf)).select("symbol", "time", "trend", "momentum", "days_listed")


@query(
    final(
        f"""(WITH RECURSIVE {V.DAILY}, n AS MATERIALIZED (SELECT symbol, time, close,
             row_number() OVER ({W}) - 1 AS t FROM bars),
        r AS (SELECT symbol, time, t, close AS e12, close AS e26, 0.0::DOUBLE AS macd_signal FROM n WHERE t = 0
              UNION ALL
              SELECT n.symbol, n.time, n.t, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27,
              macd_signal + ((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27) - macd_signal) * 2 / 10
              FROM r JOIN n ON n.symbol = r.symbol AND n.t = r.t + 1)
        SELECT symbol, time, e12 - e26 AS macd, macd_signal FROM r)""",
        "macd macd_signal",
        4,
    ),
    digits=4,
)
def technical_macd_daily(spark, sf):
    """MACD on long daily series, where averages are carried over block borders."""
    return T.add_exponential(V.daily_layer(spark, sf)).select("symbol", "time", "macd", "macd_signal")


def _live_sql(source: str = "bars", more: str = "", where: str = "") -> str:
    warm = "t >= 19"
    avg = lambda x, n: over(f"avg({x})", n)
    return f"""(WITH {V.WEEKLY},{more}
    a AS (SELECT *, row_number() OVER ({W}) - 1 AS t, {lag('close')} AS pc, count(*) OVER (PARTITION BY symbol) AS nrows
          FROM {source}),
    d AS (SELECT *, CASE WHEN pc > 0 THEN (close - pc) / pc ELSE 0 END AS returns,
          CASE WHEN close > pc THEN close - pc ELSE 0 END AS up, CASE WHEN close < pc THEN pc - close ELSE 0 END AS dn,
          CASE WHEN nrows < 2 THEN 0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
          CASE WHEN t = 0 OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS flow,
          {span('close', 12)} AS e12, {span('close', 26)} AS e26 FROM a),
    s AS (SELECT *, e12 - e26 AS macd,
          CASE WHEN t = 14 THEN {avg('up', 14)} ELSE up END AS up14,
          CASE WHEN t = 14 THEN {avg('dn', 14)} ELSE dn END AS dn14,
          {cum('flow')} AS obv,
          CASE WHEN {warm} THEN {avg('close', 20)} ELSE close END AS bb_mid,
          CASE WHEN {warm} THEN {over('stddev_pop(close)', 20)} ELSE 0 END AS sd,
          CASE WHEN t >= 13 THEN {avg('tr', 14)} ELSE tr END AS atr,
          CASE WHEN {warm} THEN volume / {avg('volume', 20)} ELSE 1 END AS volume_ratio,
          {', '.join(f"CASE WHEN t >= {n} THEN close / {lag('close', n)} - 1 ELSE 0 END AS momentum_{n}" for n in (5, 10, 20))},
          {', '.join(f"CASE WHEN t >= {n} THEN {over('stddev_pop(returns)', n)} ELSE 0 END AS volatility_{n}" for n in (5, 10, 20))}
          FROM d),
    f AS (SELECT *, {span('macd', 9)} AS macd_signal, {ewm('up14', '(1.0::DOUBLE / 14)', 14)} AS ag,
          {ewm('dn14', '(1.0::DOUBLE / 14)', 14)} AS al, {lag('obv')} AS pobv FROM s)
    SELECT symbol, time, returns, ln(1 + returns) AS log_returns,
      CASE WHEN t < 14 THEN 50 WHEN al < 1e-10 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi,
      macd, macd_signal, macd - macd_signal AS macd_hist, bb_mid + 2 * sd AS bb_upper, bb_mid, bb_mid - 2 * sd AS bb_lower,
      4 * sd / bb_mid AS bb_width,
      CASE WHEN sd > 0 THEN (close - (bb_mid - 2 * sd)) / (4 * sd) ELSE 0.5 END AS bb_pct, atr, atr / close AS atr_pct,
      CASE WHEN t > 0 AND pobv <> 0 THEN (obv - pobv)::DOUBLE / abs(pobv) ELSE 0 END AS obv_change,
      momentum_5, momentum_10, momentum_20, volatility_5, volatility_10, volatility_20, volume_ratio FROM f {where})"""


@query(final(_live_sql(), " ".join(T.LIVE_FEATURES)))
def technical_live_style(spark, sf):
    """Live-style indicators: smoothed RSI, population deviations, neutral warm-up."""
    return T.add_live(V.weekly_layer(spark, sf)).select("symbol", "time", *T.LIVE_FEATURES)


RECENT = """
    recent AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 110
               AND count(*) OVER (PARTITION BY symbol) >= 80),"""


@query(final(_live_sql("recent", RECENT, "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 60"), " ".join(T.LIVE_FEATURES)))
def live_window(spark, sf):
    """Live features of the newest 60 bars, computed from the kept 110 only."""
    return T.live_window(V.weekly_layer(spark, sf)).select("symbol", "time", *T.LIVE_FEATURES)


@query(
    f"""WITH {V.WEEKLY}, n AS (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS age,
    count(*) OVER (PARTITION BY symbol) AS have FROM bars)
    SELECT symbol, count(*) AS n_bars, min(time) AS oldest, max(have) >= 80 AS ready FROM n WHERE age <= 110 GROUP BY 1"""
)
def live_history(spark, sf):
    """Bar history kept for live scoring: the last sequence + 50 bars; ready from sequence + 20."""
    kept = L.last_n(V.weekly_layer(spark, sf), 110, order=("time",))
    return kept.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("time").alias("oldest"), (F.count(F.lit(1)) >= 80).alias("ready")
    )


@query(
    final(
        f"""(WITH {V.WEEKLY}, {V.BENCH},
        r AS (SELECT {K}, {chg('close')} AS r FROM bars), m AS (SELECT time, {chg('close')} AS m FROM bench),
        j AS (SELECT symbol, time, r, m, count(r + m) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n
              FROM r JOIN m USING (time))
        SELECT {K}, CASE WHEN n = 60 THEN {over('covar_samp(r, m)', 60)} / {over('var_samp(m)', 60)} END AS beta FROM j)""",
        "beta",
    )
)
def market_beta(spark, sf):
    """Beta against the all-market series over 60 rows."""
    df = T.add_beta(V.weekly_layer(spark, sf), V.benchmark_layer(spark, sf))
    return df.select("symbol", "time", "beta")


@query(
    final(
        f"""(WITH {V.WEEKLY}, a AS (SELECT *, {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'close', 200)} AS sma_200,
        {roll('avg', 'volume', 20)} AS volume_ma_20, {chg('close')} AS r, row_number() OVER ({W}) - 1 AS days_listed FROM bars)
        SELECT {K}, {div('close', 'sma_50')} AS price_to_sma50, {div('close', 'sma_200')} AS price_to_sma200, volume_ma_20,
        {roll('stddev_samp', 'r', 20)} * sqrt(252) AS volatility_20d, days_listed,
        CASE WHEN close > sma_200 THEN 1 ELSE -1 END AS trend FROM a)""",
        "price_to_sma50 price_to_sma200 volume_ma_20 volatility_20d",
    )
)
def technical_history_names(spark, sf):
    """The history layer's names of the same indicators."""
    df = T.add_downloader_style(V.weekly_layer(spark, sf))
    return df.select(
        "symbol", "time", "price_to_sma50", "price_to_sma200", "volume_ma_20", "volatility_20d", "days_listed", "trend"
    )
