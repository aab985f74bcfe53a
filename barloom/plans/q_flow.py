"""Institutional-flow and price-derived sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import flow as FL
from barloom.operators import proxy as P
from barloom.plans import views as V
from barloom.plans.registry import final, query
from barloom.plans.sqltext import b, chg, clip, cum, div, lag, roll

K = "symbol, time"


def z(x: str, name: str) -> str:
    return f"coalesce({x}, 0)::DOUBLE AS {name}"


FLOW = f"""
f0 AS (SELECT *, {lag('close')} AS pc, (high + low + close) / 3 AS tp, (high - low) / close AS rg,
   {chg('close')} AS ret, {chg('close', 10)} AS c10, {chg('volume', 10)} AS v10,
   {roll('avg', 'volume', 20)} AS vm, {roll('stddev_samp', 'volume', 20)} AS vs,
   {roll('stddev_samp', 'close', 20)} AS cs, {roll('min', 'low', 20)} AS lo20,
   {roll('avg', 'close', 50)} AS s50, {roll('avg', 'close', 200)} AS s200,
   (({clip('((close - low) - (high - close)) / (high - low + 1e-8)', -1, 1)}) * volume) AS mf FROM bars),
f1 AS (SELECT *, tp - {lag('tp')} AS dtp, tp * volume AS flow, {cum('mf')} AS ad, {cum('close - open')} AS smi,
   {cum('CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END')}::DOUBLE AS obv,
   {cum('tp * volume')} / {cum('volume')} AS vwap_all, {roll('avg', 'rg', 20)} AS rgm, {roll('stddev_samp', 'ret', 10)} AS vol10,
   {b('volume < vm * 0.7')} AS quiet, {b('volume > vm * 1.5')} AS busy FROM f0),
f2 AS (SELECT *, CASE WHEN dtp > 0 THEN flow ELSE 0 END AS pos, CASE WHEN dtp < 0 THEN flow ELSE 0 END AS neg,
   ad - {lag('ad', 5)} AS ad5, smi - {lag('smi', 5)} AS smi5 FROM f1),
f3 AS (SELECT *, {roll('sum', 'pos', 14)} AS ps, {roll('sum', 'neg', 14)} AS ns, {roll('stddev_samp', 'ad', 20)} AS ads,
   {roll('avg', 'obv', 20)} AS om, {roll('stddev_samp', 'obv', 50)} AS os, {roll('avg', 'vol10', 20)} AS volm,
   {roll('avg', 'quiet', 5)} AS q5 FROM f2),
f4 AS (SELECT symbol, time,
   {z('1 / (1 + exp(-(volume - vm) / (vs + 1e-8)))', 'unusual_volume')},
   {z('(' + clip('(volume / (vm + 1)) / (rg / (rgm + 1e-8) + 1)', 0, 10) + ') / 10', 'block_trade_prob')},
   ({clip('ad5 / (ads + 1e-8)', -3, 3)}) / 3 AS ad_x,
   {z('(100 - 100 / (1 + ps / (ns + 1e-8))) / 100', 'money_flow_index')},
   ({clip('smi5 / (cs + 1e-8)', -3, 3)}) / 3 AS smi_x,
   ({clip('(close - vwap_all) / vwap_all', -0.1, 0.1)}) * 10 AS vwap_x,
   ({clip('(obv - om) / (os + 1e-8)', -3, 3)}) / 3 AS obv_x,
   {z('(' + clip('-c10 * v10', -0.5, 0.5) + ') * 2', 'pv_divergence')},
   0.2::DOUBLE * {b('close < s50')} + 0.2::DOUBLE * {b('close < s200')} + 0.3::DOUBLE * {b('close < open')} * busy
     + 0.2::DOUBLE * {b('vol10 > volm')} + 0.1::DOUBLE * {b('open < pc * 0.98')} AS weak_hands_score,
   {z('0.4::DOUBLE * (' + clip('1 - (close - lo20) / (lo20 + 1e-8)', 0, 1) + ') + 0.3::DOUBLE * q5 + 0.3::DOUBLE * '
      + b('busy > 0 AND close > pc'), 'squeeze_potential')} FROM f3),
flow AS (SELECT symbol, time, unusual_volume, block_trade_prob, {z('ad_x', 'accumulation_distribution')}, money_flow_index,
   {z('smi_x', 'smart_money_index')}, {z('vwap_x', 'vwap_divergence')}, {z('obv_x', 'obv_trend')}, pv_divergence,
   weak_hands_score, squeeze_potential,
   {z('0.25::DOUBLE * ad_x + 0.25::DOUBLE * smi_x + 0.25::DOUBLE * obv_x + 0.25::DOUBLE * vwap_x', 'smart_money_flow')},
   {z('-(0.25::DOUBLE * ad_x + 0.25::DOUBLE * smi_x + 0.25::DOUBLE * obv_x + 0.25::DOUBLE * vwap_x) * weak_hands_score',
      'retail_flow')} FROM f4)"""


def _flow(columns: str) -> str:
    names = columns.split()
    return final(f"(WITH {V.WEEKLY}, {FLOW} SELECT symbol, time, {', '.join(names)} FROM flow)", columns)


def _flow_query(spark, sf, columns):
    return FL.add_flow(V.weekly_layer(spark, sf)).select("symbol", "time", *columns.split())


VOLUME_BLOCK = "unusual_volume block_trade_prob pv_divergence"
LINES = "accumulation_distribution money_flow_index smart_money_index vwap_divergence obv_trend"
CROWD = "weak_hands_score squeeze_potential smart_money_flow retail_flow"


@query(_flow(VOLUME_BLOCK))
def flow_volume_block(spark, sf):
    """Unusual volume, block trades, price-volume divergence."""
    return _flow_query(spark, sf, VOLUME_BLOCK)


@query(_flow(LINES))
def flow_ad_mfi_obv_vwap(spark, sf):
    """Accumulation/distribution, money flow, smart money, VWAP and OBV features."""
    return _flow_query(spark, sf, LINES)


@query(_flow(CROWD))
def flow_weak_squeeze(spark, sf):
    """Weak hands, squeeze potential and the two composites."""
    return _flow_query(spark, sf, CROWD)


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FLOW}, x AS (SELECT * FROM flow
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1)
        SELECT symbol, time, unusual_volume AS unusual_volume_score, block_trade_prob AS block_trade_indicator,
        accumulation_distribution AS accumulation_score, -accumulation_distribution AS distribution_score,
        smart_money_flow, retail_flow, weak_hands_score, squeeze_potential AS short_squeeze_potential,
        CASE WHEN smart_money_flow > 0.3 AND weak_hands_score > 0.5 THEN 'accumulating'
             WHEN smart_money_flow < -0.3 AND weak_hands_score < 0.3 THEN 'distributing'
             WHEN squeeze_potential > 0.6 THEN 'squeeze_setup' ELSE 'none' END AS reading FROM x)""",
        "unusual_volume_score block_trade_indicator accumulation_score distribution_score smart_money_flow retail_flow "
        "weak_hands_score short_squeeze_potential",
    )
)
def flow_latest_signals(spark, sf):
    """Newest flow summary per symbol with its reading."""
    return FL.latest_signals(FL.add_flow(V.weekly_layer(spark, sf)))


@query(
    final(
        """(SELECT s_suppkey, CASE WHEN s_nationkey % 3 > 0 THEN (s_suppkey % 40)::DOUBLE / ((s_nationkey % 3) * 100) * 100
            WHEN s_nationkey > 0 THEN (s_suppkey % 40)::DOUBLE / (s_nationkey * 50) * 100 END AS short_interest FROM supplier)""",
        "short_interest",
    )
)
def short_interest(spark, sf):
    """Short interest percent with the float / outstanding fallback."""
    s = V.table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.col("s_suppkey") % 40).alias("shares_short"),
        ((F.col("s_nationkey") % 3) * 100).alias("float_shares"),
        (F.col("s_nationkey") * 50).alias("shares_outstanding"),
    )
    return FL.short_interest_pct(s).select("s_suppkey", "short_interest")


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FLOW}, m AS (SELECT n_name AS symbol, 15.0::DOUBLE + n_nationkey AS si FROM nation)
        SELECT symbol, time, CASE WHEN si > 20 THEN least(1.0, greatest(0.0, raw * (1 + si / 100))) ELSE raw END
        AS squeeze_potential FROM (SELECT symbol, time, squeeze_potential AS raw, si FROM flow JOIN m USING (symbol)))""",
        "squeeze_potential",
    )
)
def flow_with_short_interest(spark, sf):
    """Flow analysis joined with short interest: the squeeze score is boosted above 20 percent."""
    si = V.table(spark, sf, "nation").select(
        F.col("n_name").alias("symbol"), (F.col("n_nationkey") + F.lit(15.0)).alias("si")
    )
    bars = V.weekly_layer(spark, sf).join(si, "symbol")
    return FL.add_flow(bars, short_interest="si").select("symbol", "time", "squeeze_potential")


PROXY = f"""
rel AS (SELECT symbol, time, r - m AS excess, CASE WHEN count(r) OVER w = 20 AND count(m) OVER w = 20 THEN
     exp(sum(ln(1 + r)) OVER w) / exp(sum(ln(1 + m)) OVER w) - 1 END AS strength
   FROM (SELECT symbol, time, {chg('close')} AS r FROM bars) JOIN (SELECT time, {chg('close')} AS m FROM bench) USING (time)
   WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
p0 AS (SELECT *, {lag('close')} AS pc, {roll('avg', 'volume', 20)} AS vm, (high - low) / open AS rg,
   {chg('close', 5)} AS c5, {chg('volume', 5)} AS v5 FROM bars LEFT JOIN rel USING (symbol, time)),
p1 AS (SELECT *, (open - pc) / pc AS gap, (volume - vm) / (vm + 1e-8) AS vsur, {roll('avg', 'rg', 20)} AS rgm,
   (close - low) / (high - low + 1e-8) AS cpos FROM p0),
p2 AS (SELECT *, vsur * {b('close > open')} AS bull, vsur * {b('close < open')} AS bear, ({div('rg', 'rgm')}) AS rexp FROM p1),
p3 AS (SELECT *, rexp * {b('close < open')} AS fear FROM p2),
p4 AS (SELECT *, 0.2::DOUBLE * ({clip('gap', -0.1, 0.1)}) * 10 + 0.2::DOUBLE * (cpos * 2 - 1) + 0.2::DOUBLE * tanh(bull - bear)
   - 0.2::DOUBLE * tanh(fear) + 0.2::DOUBLE * ({clip('excess', -0.05, 0.05)}) * 20 AS sp FROM p3),
p5 AS (SELECT *, {roll('avg', 'sp', 5)} AS sps FROM p4)"""


def _proxy(items: dict[str, str]) -> str:
    body = ", ".join(z(x, n) for n, x in items.items())
    return final(f"(WITH {V.WEEKLY}, {V.BENCH}, {PROXY} SELECT symbol, time, {body} FROM p5)", " ".join(items))


def _proxy_query(spark, sf, items):
    df = P.add_proxy(V.weekly_layer(spark, sf), V.benchmark_layer(spark, sf))
    return df.select("symbol", "time", *items)


GAPS = {
    "overnight_gap": "gap",
    "gap_direction": "sign(gap)",
    "gap_magnitude": "abs(gap)",
    "large_gap_up": b("gap > 0.02"),
    "large_gap_down": b("gap < -0.02"),
    "gap_reversal": "-gap * (close - open) / open",
    "volume_surprise": "vsur",
    "bullish_volume": "bull",
    "bearish_volume": "bear",
    "sent_daily_range": "rg",
    "range_expansion": "rexp",
    "fear_signal": "fear",
    "close_position": "cpos",
}
RELATIVE = {"excess_return": "excess", "relative_strength": "strength"}
COMPOSITE = {
    "momentum_divergence": "c5 / (abs(v5) + 0.01)",
    "sentiment_proxy": "sp",
    "sentiment_proxy_smooth": "sps",
}


@query(_proxy(GAPS))
def proxy_gap_volume_range(spark, sf):
    """Gap, volume and range sentiment."""
    return _proxy_query(spark, sf, GAPS)


@query(_proxy(RELATIVE))
def proxy_relative_strength(spark, sf):
    """Excess return and relative strength against the market series."""
    return _proxy_query(spark, sf, RELATIVE)


@query(_proxy(COMPOSITE))
def proxy_composite(spark, sf):
    """Momentum divergence and the composite sentiment proxy."""
    return _proxy_query(spark, sf, COMPOSITE)


@query(
    final(
        f"""(WITH {V.WEEKLY}, {V.BENCH}, {PROXY}, i AS (SELECT symbol, time,
        0.4::DOUBLE * ({clip('abs(vsur)', 0, 5)}) / 5 + 0.3::DOUBLE * ({clip('abs(gap)', 0, 0.1)}) / 0.1::DOUBLE
        + 0.3::DOUBLE * ({clip('rg / (rgm + 1e-8) - 1', 0, 3)}) / 3 AS x FROM p5)
        SELECT symbol, time, {clip('x', 0, 1)} AS news_intensity FROM i)""",
        "news_intensity",
    )
)
def news_intensity(spark, sf):
    """News intensity from volume, gap and range."""
    df = P.add_proxy(V.weekly_layer(spark, sf), V.benchmark_layer(spark, sf))
    return df.select("symbol", "time", "news_intensity")
