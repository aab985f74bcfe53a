"""Screening, fusion, risk, message and market-hour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import flow as FL
from barloom.operators import latest as L
from barloom.operators import screen as SCR
from barloom.operators import signals as SG
from barloom.operators import technical as T
from barloom.plans import views as V
from barloom.plans.q_flow import FLOW
from barloom.plans.registry import final, query
from barloom.plans.sqltext import W, b, chg, clip, div, lag, over, roll
from barloom.sources import messages as MS
from barloom.sources.stage import layer, stage

FACTORS = ("momentum_5", "momentum_20", "volume_ratio", "bb_position", "news_sentiment")
FACTOR_SQL = f"""{V.WEEKLY}, {V.ARTICLES},
  fa AS (SELECT symbol, time, close, {chg('close', 5)} AS momentum_5, {chg('close', 20)} AS momentum_20,
    volume / ({roll('avg', 'volume', 20)}) AS volume_ratio, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars),
  ns AS (SELECT symbol, avg(sentiment) AS news_sentiment FROM articles GROUP BY 1),
  fb AS (SELECT symbol, time, close, momentum_5, momentum_20, volume_ratio, (close - (m - 2 * s)) / (4 * s) AS bb_position, news_sentiment
    FROM fa LEFT JOIN ns USING (symbol)),
  st AS (SELECT time, {", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FACTORS)} FROM fb GROUP BY 1),
  zz AS (SELECT symbol, time, close, {", ".join(f"CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} WHEN {f} IS NOT NULL THEN 0 END AS z_{f}" for f in FACTORS)}
    FROM fb JOIN st USING (time)),
  sc AS (SELECT *, CASE WHEN z_momentum_5 IS NULL AND z_momentum_20 IS NULL THEN 0 ELSE (coalesce(z_momentum_5, 0) + coalesce(z_momentum_20, 0))
      / ((z_momentum_5 IS NOT NULL)::INT + (z_momentum_20 IS NOT NULL)::INT) END AS momentum_score,
    coalesce(z_volume_ratio, 0) AS volume_score, coalesce(z_bb_position, 0) AS volatility_score, coalesce(z_news_sentiment, 0) AS sentiment_score FROM zz),
  sd AS (SELECT *, 0.4::DOUBLE * momentum_score + 0.2::DOUBLE * volume_score + 0.15::DOUBLE * volatility_score + 0.25::DOUBLE * sentiment_score AS composite_score FROM sc),
  rk AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY composite_score DESC, symbol) AS rn FROM sd)"""


def factors(spark, sf):
    """The factor table of the screener, stored once: it is read for the statistics and for the scores."""

    def build():
        t = T.add_technical(V.weekly_layer(spark, sf), ema=False)
        n = V.articles(spark, sf).groupBy("symbol").agg(F.avg("sentiment").alias("news_sentiment"))
        return t.join(n, "symbol", "left").select("symbol", "time", "close", "returns", "volatility_20", *FACTORS)

    return layer(spark, "factors", sf, build)


@query(final(f"(WITH {FACTOR_SQL} SELECT symbol, time, {', '.join(f'z_{f}' for f in FACTORS)} FROM zz)", " ".join(f"z_{f}" for f in FACTORS)))
def factor_zscores(spark, sf):
    """Cross-sectional z-scores per week."""
    return SCR.zscores(factors(spark, sf), FACTORS).select("symbol", "time", *(f"z_{f}" for f in FACTORS))


@query(
    final(
        f"""(WITH {FACTOR_SQL} SELECT symbol, time, rn::INTEGER AS "rank", composite_score, momentum_score, volume_score, volatility_score,
        sentiment_score FROM rk WHERE rn <= 20)""",
        "composite_score momentum_score volume_score volatility_score sentiment_score",
    )
)
def screener_top20(spark, sf):
    """Composite score and the top 20 symbols of every week."""
    return SCR.screen(factors(spark, sf)).select(
        "symbol", "time", "rank", "composite_score", "momentum_score", "volume_score", "volatility_score", "sentiment_score"
    )


@query(
    final(
        f"""(WITH {V.WEEKLY}, a AS (SELECT *, {lag('close')} AS pc FROM bars), t AS (SELECT symbol, time,
          greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM a), r AS (SELECT symbol, time, {roll('avg', 'tr', 14)} AS atr FROM t),
        l AS (SELECT symbol, time, atr, list(atr) FILTER (WHERE atr IS NOT NULL) OVER ({W} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS v FROM r)
        SELECT symbol, time, CASE WHEN atr IS NOT NULL AND len(v) > 1 THEN len(list_filter(v, lambda x: x < atr)) / (len(v) - 1) END AS atr_percentile FROM l)""",
        "atr_percentile",
    )
)
def atr_percentile(spark, sf):
    """ATR against its own last 52 rows."""
    t = T.add_technical(V.weekly_layer(spark, sf), ema=False).select("symbol", "time", "_t", "atr_14")
    return SCR.trailing_percentile(t, "atr_14", "atr_percentile", 52).drop("atr_14", "_t")


REGIME = """CASE CAST(substr(symbol, 8) AS INTEGER) % 5 WHEN 0 THEN 'trending' WHEN 1 THEN 'mean_reverting' WHEN 2 THEN 'high_volatility'
  WHEN 3 THEN 'low_volatility' ELSE 'other' END"""
SIGNAL_SQL = f"""{FACTOR_SQL}, vo AS (SELECT symbol, time, {roll('stddev_samp', 'r', 20)} AS volatility, r FROM (SELECT symbol, time, {chg('close')} AS r FROM bars)),
  sg0 AS (SELECT symbol, time, close AS price, composite_score AS technical, {REGIME} AS regime, r / 10 AS expected_return, volatility,
    1 / (1 + exp(-r)) AS trend_probability, least(1.0, abs(r)) AS confidence, news_sentiment AS weighted_sentiment
    FROM sd JOIN vo USING (symbol, time) JOIN ns USING (symbol) WHERE r IS NOT NULL),
  sg1 AS (SELECT *, tanh(technical) AS technical_signal, trend_probability * 2 - 1 AS prediction_signal, coalesce(weighted_sentiment, 0) AS sentiment_signal,
    CASE regime WHEN 'trending' THEN 0.3 WHEN 'mean_reverting' THEN 0.5 WHEN 'high_volatility' THEN 0.25 WHEN 'low_volatility' THEN 0.4 ELSE 0.35 END::DOUBLE AS w1,
    CASE regime WHEN 'trending' THEN 0.5 WHEN 'mean_reverting' THEN 0.3 WHEN 'high_volatility' THEN 0.25 WHEN 'low_volatility' THEN 0.4 ELSE 0.4 END::DOUBLE AS w2,
    CASE regime WHEN 'trending' THEN 0.2 WHEN 'mean_reverting' THEN 0.2 WHEN 'high_volatility' THEN 0.5 WHEN 'low_volatility' THEN 0.2 ELSE 0.25 END::DOUBLE AS w3 FROM sg0),
  sg2 AS (SELECT *, w1 * technical_signal + w2 * prediction_signal + w3 * sentiment_signal AS composite_signal FROM sg1),
  sg3 AS (SELECT *, greatest(0.3, least(0.7, 0.5 + composite_signal * 0.25 * confidence))::DOUBLE AS wp,
     CASE WHEN volatility > 0 THEN greatest(0.5, least(3.0, expected_return / volatility))::DOUBLE END AS wl FROM sg2),
  sg AS (SELECT *, greatest(0, least(0.1, (wp * wl - (1 - wp)) / wl * 0.5))::DOUBLE * confidence AS ps, expected_return / nullif(volatility, 0) AS sharpe_estimate,
    CASE WHEN composite_signal >= 0.7 THEN 'STRONG_BUY' WHEN composite_signal >= 0.3 THEN 'BUY' WHEN composite_signal <= -0.7 THEN 'STRONG_SELL'
      WHEN composite_signal <= -0.3 THEN 'SELL' ELSE 'HOLD' END AS action,
    price * CASE WHEN composite_signal >= 0 THEN 0.95 ELSE 1.05 END::DOUBLE AS stop_loss,
    price * CASE WHEN composite_signal >= 0 THEN 1.1 ELSE 0.9 END::DOUBLE AS take_profit FROM sg3)"""


def signals(spark, sf):
    f = factors(spark, sf)
    scored = SCR.composite(SCR.zscores(f, FACTORS))
    screener = scored.select("symbol", "time", F.col("close").alias("price"), F.col("composite_score").alias("technical"))
    r = F.col("returns")
    prediction = f.filter(r.isNotNull()).select(
        "symbol",
        "time",
        (1 / (1 + F.exp(-r))).alias("trend_probability"),
        F.least(F.lit(1.0), F.abs(r)).alias("confidence"),
        (r / 10).alias("expected_return"),
        (F.col("volatility_20") / 252**0.5).alias("volatility"),
    )
    sentiment = f.select("symbol", "time", F.col("news_sentiment").alias("weighted_sentiment"))
    k = F.substring("symbol", 8, 4).cast("int") % 5
    names = F.array(*(F.lit(x) for x in ("trending", "mean_reverting", "high_volatility", "low_volatility", "other")))
    df = SG.assemble(screener, prediction, sentiment).withColumn("regime", F.element_at(names, k + 1))
    return SG.risk_columns(SG.fuse(df))


@query(
    final(
        f"""(WITH {SIGNAL_SQL} SELECT symbol, time, regime, technical_signal, prediction_signal, sentiment_signal, composite_signal, confidence, action,
        stop_loss, take_profit FROM sg)""",
        "technical_signal prediction_signal sentiment_signal composite_signal confidence stop_loss take_profit",
    )
)
def signal_fusion(spark, sf):
    """Screener, prediction and sentiment fused by regime weights, with action and stops."""
    return signals(spark, sf).select(
        "symbol", "time", "regime", "technical_signal", "prediction_signal", "sentiment_signal", "composite_signal", "confidence",
        "action", "stop_loss", "take_profit",
    )


@query(final(f"(WITH {SIGNAL_SQL} SELECT symbol, time, CASE WHEN wl IS NOT NULL THEN ps END AS position_size, sharpe_estimate FROM sg)", "position_size sharpe_estimate"))
def position_size(spark, sf):
    """Half-Kelly position size and Sharpe estimate."""
    return signals(spark, sf).select("symbol", "time", "position_size", "sharpe_estimate")


@query(
    final(
        f"""(WITH {SIGNAL_SQL} SELECT time, composite_signal, action, confidence FROM sg WHERE symbol = 'NATION_3' ORDER BY time DESC LIMIT 1)""",
        "composite_signal confidence",
    )
)
def latest_signal(spark, sf):
    """Newest signal of one symbol."""
    return L.latest_signal(signals(spark, sf), "NATION_3")


@query(
    final(
        """(WITH d AS (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS a, (doc_id % 7) / 6.0::DOUBLE AS b, (doc_id % 5) / 4.0::DOUBLE AS c FROM documents),
        m AS (SELECT doc_id, a * 0.4::DOUBLE + b * 0.4::DOUBLE + c * 0.2::DOUBLE AS composite FROM d)
        SELECT doc_id, composite, CASE WHEN composite > 0.6::DOUBLE THEN 'BUY' WHEN composite < 0.4::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS signal FROM m)""",
        "composite",
    )
)
def dashboard_signal(spark, sf):
    """The dashboard's composite and signal."""
    k = F.col("doc_id")
    parts = SG.dashboard_signal((k % 11) / 10.0, (k % 7) / 6.0, (k % 5) / 4.0)
    return V.table(spark, sf, "documents").select("doc_id", *(x.alias(n) for n, x in parts.items()))


# -- orders and positions ------------------------------------------------------------------------

ORDERS = """od AS (SELECT o_orderkey, n_name AS symbol, r_name AS portfolio, c_mktsegment AS sector, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS side,
   1 + o_orderkey % 50 AS quantity, o_totalprice AS value, o_totalprice / (1 + o_orderkey % 50) AS price, o_orderdate AS time
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  ex AS (SELECT portfolio, sector, sum(value) AS sector_value FROM od GROUP BY 1, 2),
  pf AS (SELECT portfolio, 3.6::DOUBLE * sum(sector_value) / 1000 AS total_value, -sum(sector_value) / 1000 * CASE WHEN portfolio = 'ASIA' THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS daily_pnl,
   CASE WHEN portfolio = 'EUROPE' THEN 31.0 WHEN portfolio = 'AFRICA' THEN 30.0 ELSE 18.0 END::DOUBLE AS vix FROM ex GROUP BY 1)"""


def _orders(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    return (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "o_orderkey",
            F.col("n_name").alias("symbol"),
            F.col("r_name").alias("portfolio"),
            F.col("c_mktsegment").alias("sector"),
            F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("side"),
            (1 + F.col("o_orderkey") % 50).alias("quantity"),
            F.col("o_totalprice").alias("value"),
            (F.col("o_totalprice") / (1 + F.col("o_orderkey") % 50)).alias("price"),
            F.col("o_orderdate").alias("time"),
        )
    )


def _validated(spark, sf):
    o = layer(spark, "orders", sf, lambda: _orders(spark, sf))
    ex = stage(SG.exposures(o), "exposures")  # a row per portfolio and sector
    p = F.col("portfolio")
    pf = ex.select("portfolio", "total_exposure").distinct().select(
        "portfolio",
        (F.col("total_exposure") * 3.6 / 1000).alias("total_value"),
        (-F.col("total_exposure") / 1000 * F.when(p == "ASIA", 0.1).otherwise(0.01)).alias("daily_pnl"),
        F.when(p == "EUROPE", 31.0).when(p == "AFRICA", 30.0).otherwise(18.0).alias("vix"),
    )
    held = ex.select("portfolio", "sector", (F.col("sector_value") / 1000).alias("sector_value"))
    return SG.validate_orders(o, pf, held)


@query(final(f"(WITH {ORDERS} SELECT portfolio, sector, sector_value, sum(sector_value) OVER (PARTITION BY portfolio) AS total_exposure FROM ex)", "sector_value total_exposure", 2), digits=2)
def exposures(spark, sf):
    """Sector and total exposure per portfolio."""
    return SG.exposures(_orders(spark, sf))


VALID = f"""{ORDERS}, vd AS (SELECT o_orderkey, time, symbol, side, price, quantity, CASE WHEN value / total_value > 0.1 THEN 'Position size exceeds limit'
    WHEN (sector_value / 1000 + value) / total_value > 0.3 THEN 'Sector exposure exceeds limit'
    WHEN daily_pnl / total_value < -0.02 THEN 'Daily loss limit reached' END AS reason, vix FROM od JOIN pf USING (portfolio) JOIN ex USING (portfolio, sector))"""


@query(f"""WITH {VALID} SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'APPROVED' ELSE 'REJECTED' END AS decision, reason,
    CAST(CASE WHEN reason IS NOT NULL THEN 0 WHEN vix > 30 THEN floor(quantity * 0.5) ELSE quantity END AS BIGINT) AS adj_quantity FROM vd""")
def order_validation(spark, sf):
    """Orders checked against position, sector, loss and volatility rules."""
    return _validated(spark, sf).select("o_orderkey", "decision", "reason", "adj_quantity")


@query(final(f"""(WITH {VALID} SELECT o_orderkey, 'ORDER' AS event_type, symbol, side, CAST(quantity AS BIGINT) AS quantity, price,
    coalesce(reason, 'APPROVED') AS decision FROM vd)""", "price"))
def audit_events(spark, sf):
    """Order audit rows with their JSON details read back."""
    v = _validated(spark, sf)
    rows = MS.audit_orders(v.withColumn("symbol", F.concat_ws("|", "symbol", "o_orderkey")))
    d = F.from_json("details", "side string, quantity bigint, price double, decision string")
    at = F.split("symbol", r"\|")
    return rows.select("event_type", at[0].alias("symbol"), at[1].cast("long").alias("o_orderkey"), d.alias("d")).select(
        "o_orderkey", "event_type", "symbol", "d.*"
    )


@query(f"""WITH {ORDERS}, s AS (SELECT portfolio, max(value) AS max_value, count(DISTINCT symbol) AS n_positions, sum(value) AS invested FROM od GROUP BY 1),
    t AS (SELECT *, invested * CASE WHEN portfolio < 'B' THEN 1.3 ELSE 1.2 END::DOUBLE AS total_value FROM s)
    SELECT portfolio, max_value <= 50000 AS position_ok, n_positions <= 20 AS count_ok, invested <= total_value * 0.8::DOUBLE AS invested_ok,
    total_value - invested >= total_value * 0.2::DOUBLE AS cash_ok FROM t""")
def portfolio_caps(spark, sf):
    """Portfolio caps as flags."""
    o = _orders(spark, sf)
    s = o.groupBy("portfolio").agg(
        F.max("value").alias("max_value"), F.countDistinct("symbol").alias("n_positions"), F.sum("value").alias("invested")
    )
    s = s.withColumn("total_value", F.col("invested") * F.when(F.col("portfolio") < "B", 1.3).otherwise(1.2))
    return SG.portfolio_caps(s).select("portfolio", "position_ok", "count_ok", "invested_ok", "cash_ok")


@query(
    final(
        f"""(WITH {V.WEEKLY}, e AS (SELECT symbol, arg_min(time, time) + INTERVAL 70 DAY AS entry_time, arg_min(close, time) AS entry_price FROM bars GROUP BY 1),
        h AS (SELECT bars.*, entry_price FROM bars JOIN e USING (symbol) WHERE time >= entry_time),
        s AS (SELECT symbol, time, low, entry_price * 0.95::DOUBLE AS fixed_stop, max(high) OVER ({W} ROWS UNBOUNDED PRECEDING) * 0.97::DOUBLE AS trailing_stop FROM h)
        SELECT symbol, time, fixed_stop, trailing_stop, low <= greatest(fixed_stop, trailing_stop) AS hit FROM s)""",
        "fixed_stop trailing_stop",
    )
)
def trailing_stop(spark, sf):
    """Fixed and trailing stops since entry."""
    bars = V.weekly_layer(spark, sf)
    e = bars.groupBy("symbol").agg(F.min("time").alias("t0"), F.min_by("close", "time").alias("entry_price"))
    e = e.select("symbol", "entry_price", (F.col("t0") + F.make_dt_interval(days=F.lit(70))).alias("entry_time"))
    return SG.trailing_stops(bars, e).select("symbol", "time", "fixed_stop", "trailing_stop", "hit")


@query(
    final(
        f"""(WITH {V.WEEKLY}, {ORDERS}, lp AS (SELECT symbol, arg_max(close, time) AS current_price FROM bars GROUP BY 1),
        p AS (SELECT o_orderkey, symbol, quantity, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE price END AS avg_cost FROM od)
        SELECT o_orderkey, quantity * current_price AS market_value, (current_price - avg_cost) * quantity AS unrealized_pnl,
        CASE WHEN avg_cost * quantity > 0 THEN (current_price - avg_cost) * quantity / (avg_cost * quantity) * 100 ELSE 0 END AS pnl_pct FROM p LEFT JOIN lp USING (symbol))""",
        "market_value unrealized_pnl pnl_pct",
    )
)
def position_pnl(spark, sf):
    """Market value and unrealised profit of positions at the latest price."""
    pos = _orders(spark, sf).select(
        "o_orderkey", "symbol", "quantity", F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(F.col("price")).alias("avg_cost")
    )
    out = SG.position_pnl(pos, L.latest_price(V.weekly_layer(spark, sf)))
    return out.select("o_orderkey", "market_value", "unrealized_pnl", "pnl_pct")


@query("""WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events),
    m AS (SELECT event_id, dayofweek(t) IN (0, 6) AS weekend, hour(t) * 60 + minute(t) AS minute_ FROM l)
    SELECT event_id, CASE WHEN weekend THEN 'CLOSED' WHEN minute_ < 570 THEN 'PRE_MARKET' WHEN minute_ >= 960 THEN 'AFTER_HOURS' ELSE 'OPEN' END AS status,
    NOT weekend AND minute_ >= 570 AND minute_ < 960 AS is_open FROM m""")
def market_status(spark, sf):
    """Market status of every event time."""
    t = F.col("ts").cast("timestamp")
    return V.table(spark, sf, "events").select("event_id", SG.market_status(t).alias("status"), SG.is_market_hours(t).alias("is_open"))


# -- messages ------------------------------------------------------------------------------------


def _messages(spark, sf, ticks=None):
    """Every event as a vendor message: objects, arrays, status lines, items without a kind, broken text."""
    t = V.event_ticks(spark, sf) if ticks is None else ticks
    ns = MS.timestamp_to_ns(F.col("time"))
    cond = F.array(*(F.lit(i) for i in range(6)))
    trade = F.to_json(F.struct(F.lit("T").alias("ev"), F.col("symbol").alias("sym"), ns.alias("t"), F.col("price").alias("p"),
                               F.col("size").alias("s"), F.lit(4).alias("x"), cond.alias("c")))
    quote = F.to_json(F.struct(F.lit("Q").alias("ev"), F.col("symbol").alias("sym"), ns.alias("t"), (F.col("price") - 1).alias("bp"),
                               (F.col("price") + 1).alias("ap"), F.col("size").alias("bs"), F.lit(7).alias("as")))
    bar = F.to_json(F.struct(F.lit("AM").alias("ev"), F.col("symbol").alias("sym"), F.call_function("div", ns, F.lit(1000000)).alias("s"), F.col("price").alias("o"),
                             (F.col("price") + 2).alias("h"), (F.col("price") - 2).alias("l"), F.col("price").alias("c"),
                             F.col("size").alias("v"), F.col("price").alias("vw"), F.lit(3).alias("n")))
    k = F.col("seq") % 5
    text = (
        F.when(k == 0, trade)
        .when(k == 1, F.concat(F.lit("["), trade, F.lit(","), quote, F.lit("]")))
        .when(k == 2, F.concat(F.lit("["), bar, F.lit(', {"ev":"status"}, {"sym":"X"}]')))
        .when(k == 3, F.concat(F.lit('{"no": '), F.col("seq"), F.lit("}")))
        .otherwise(F.concat(F.lit("broken "), trade))
    )
    return t.select("seq", text.alias("value"))


DECODED = f"""{V.TICKS}, de AS (SELECT *, seq % 5 AS k, epoch_us(time) * 1000 AS ns FROM ticks)"""


@query(
    final(
        f"""(WITH {DECODED} SELECT seq, 'T' AS kind, symbol, time, ns AS ts_ns, price, CAST(size AS BIGINT) AS size, '0,1,2,3' AS conditions, NULL::DOUBLE AS ask FROM de WHERE k IN (0, 1)
        UNION ALL SELECT seq, 'Q', symbol, time, ns, price - 1, CAST(size AS BIGINT), NULL, price + 1 FROM de WHERE k = 1
        UNION ALL SELECT seq, 'A', symbol, date_trunc('millisecond', time), (ns // 1000000) * 1000000, price, CAST(size AS BIGINT), NULL, NULL FROM de WHERE k = 2)""",
        "price ask",
    )
)
def stream_decode(spark, sf):
    """Vendor messages decoded into trades, quotes and bars."""
    items = MS.decode_items(_messages(spark, sf))
    ntz = F.col("time").cast("timestamp_ntz").alias("time")
    none = F.lit(None).cast("string").alias("conditions")
    t = MS.trades(items, conditions=4).select("seq", F.lit("T").alias("kind"), "symbol", ntz, "ts_ns", "price", "size",
                                F.array_join("conditions", ",").alias("conditions"), F.lit(None).cast("double").alias("ask"))
    q = MS.quotes(items).select("seq", F.lit("Q").alias("kind"), "symbol", ntz, "ts_ns", F.col("bid").alias("price"),
                                F.col("bid_size").cast("long").alias("size"), none, "ask")
    b_ = MS.bars(items).select("seq", F.lit("A").alias("kind"), "symbol", ntz, "ts_ns", F.col("close").alias("price"),
                               F.col("volume").alias("size"), none, F.lit(None).cast("double").alias("ask"))
    return t.unionByName(q).unionByName(b_)


@query(
    final(
        f"""(WITH {DECODED} SELECT seq, 'TRADE' AS topic, symbol, time, price, CASE WHEN k = 0 THEN '' ELSE exchange END AS text FROM de
        UNION ALL SELECT seq, 'SIGNAL', symbol, time, CASE WHEN k = 1 THEN 0 ELSE price END, CASE WHEN k = 2 THEN 'HOLD' ELSE 'BUY' END FROM de)""",
        "price",
    )
)
def topic_json(spark, sf):
    """Rows published as topic messages and decoded again, with defaults for missing fields."""
    t = V.event_ticks(spark, sf).withColumn("timestamp", MS.timestamp_to_ns(F.col("time")))
    k = F.col("seq") % 5
    trade = MS.to_topic(t.withColumn("exchange", F.when(k != 0, F.col("exchange"))), "TRADE", keep=("seq",))
    sig = t.withColumns({"signal_type": F.when(k != 2, "BUY"), "strength": F.when(k != 1, F.col("price")), "source": F.lit("model")})
    both = trade.unionByName(MS.to_topic(sig, "SIGNAL", keep=("seq",)))
    ntz = F.col("time").cast("timestamp_ntz").alias("time")
    a = MS.from_topic(both, "TRADE", keep=("seq",)).select("seq", F.lit("TRADE").alias("topic"), "symbol", ntz, "price", F.col("exchange").alias("text"))
    b_ = MS.from_topic(both, "SIGNAL", keep=("seq",)).select(
        "seq", F.lit("SIGNAL").alias("topic"), "symbol", ntz, F.col("strength").alias("price"), F.col("signal_type").alias("text")
    )
    return a.unionByName(b_)


@query(
    final(
        f"""(WITH {FACTOR_SQL} SELECT time, rn::INTEGER AS "rank", symbol, composite_score, momentum_score AS momentum FROM rk WHERE rn <= 20)""",
        "composite_score momentum",
        5,
    ),
    digits=5,
)
def rankings_message(spark, sf):
    """Ranking messages per week, read back from their JSON."""
    msg = MS.rankings_message(SCR.screen(factors(spark, sf)))
    schema = "rankings array<struct<rank int, symbol string, composite_score double, factors struct<momentum double>>>"
    items = msg.select("time", F.explode(F.from_json("value", schema)["rankings"]).alias("r"))
    return items.select("time", "r.rank", "r.symbol", "r.composite_score", F.col("r.factors.momentum").alias("momentum"))


@query(f"""WITH {V.TICKS} SELECT seq, epoch_us(time) * 1000 AS ns, strftime(time, '%Y-%m-%dT%H:%M:%S.%g') AS iso FROM ticks""")
def time_codes(spark, sf):
    """Nanosecond and ISO forms of times, there and back."""
    ns = MS.timestamp_to_ns(F.col("time"))
    back = MS.ns_to_timestamp(ns)
    return V.event_ticks(spark, sf).select("seq", ns.alias("ns"), MS.iso_millis(back).alias("iso"))
