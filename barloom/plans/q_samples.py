"""Targets, sequences, labels, splits, normalisation, metrics and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import finite, pct
from barloom.functions.series import Series
from barloom.operators import families as FA
from barloom.operators import metrics as M
from barloom.operators import samples as S
from barloom.operators import stats as ST
from barloom.operators import technical as T
from barloom.plans import views as V
from barloom.plans.q_flow import FLOW, PROXY
from barloom.plans.registry import final, query
from barloom.plans.sqltext import W, b, chg, clip, div, lag, over, roll

K = "symbol, time"


def lead(x: str, n: int) -> str:
    return over(f"lead({x}, {n})")


def _targets() -> str:
    rets = ", ".join(f"{lead('close', h)} / close - 1 AS r{h}" for h in (1, 5, 10))
    cols = ", ".join(
        f"r{h} AS target_return_{h}d, CASE WHEN r{h} > 0.02 THEN 1 WHEN r{h} < -0.02 THEN -1 ELSE 0 END AS "
        f"target_direction_{h}d, CASE WHEN r{h} > 0 THEN 1 ELSE 0 END AS target_up_{h}d"
        for h in (1, 5, 10)
    )
    return f"(WITH {V.WEEKLY}, a AS (SELECT {K}, {rets} FROM bars) SELECT {K}, {cols} FROM a)"


@query(final(_targets(), "target_return_1d target_return_5d target_return_10d"))
def forward_targets(spark, sf):
    """Forward returns, directions and up flags."""
    df = S.add_targets(V.weekly_layer(spark, sf))
    kinds = ("return", "direction", "up")
    return df.select("symbol", "time", *(f"target_{k}_{h}d" for h in (1, 5, 10) for k in kinds))


# lifetimes: every order date of a customer is a trading day, the last one its delisting
LIFE = """life AS (SELECT concat('C', o_custkey) AS symbol, o_orderdate AS time, avg(o_totalprice) AS close
  FROM orders GROUP BY 1, 2), meta AS (SELECT concat('C', c_custkey) AS symbol, c_mktsegment AS delist_reason FROM customer)"""


def _lifetimes(spark, sf):
    o = V.table(spark, sf, "orders")
    prices = o.groupBy(F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.col("o_orderdate").alias("time")).agg(
        F.avg("o_totalprice").alias("close")
    )
    meta = V.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.col("c_mktsegment").alias("delist_reason")
    )
    return prices, meta


LABELS = f"""{LIFE}, labels_ AS (SELECT symbol, time AS date, delist_reason, CAST(date_diff('day', time,
  max(time) OVER (PARTITION BY symbol)) AS INTEGER) AS days_to_delist FROM life JOIN meta USING (symbol)),
  delist AS (SELECT *, {", ".join(f"CASE WHEN days_to_delist <= {h} THEN 1 ELSE 0 END AS delist_{h}d" for h in S.HORIZONS)}
  FROM labels_)"""


@query(f"WITH {LABELS} SELECT * FROM delist")
def delisting_labels(spark, sf):
    """Days to the last trading day and the horizon flags."""
    prices, meta = _lifetimes(spark, sf)
    return S.delisting_labels(prices, meta)


@query(
    final(
        f"""(WITH {LABELS}, s AS (SELECT avg(delist_30d) a, avg(delist_90d) b, avg(delist_180d) c, avg(delist_365d) d FROM delist)
        SELECT 'delist_30d' AS label, a * 100 AS positive_pct FROM s UNION ALL SELECT 'delist_90d', b * 100 FROM s
        UNION ALL SELECT 'delist_180d', c * 100 FROM s UNION ALL SELECT 'delist_365d', d * 100 FROM s)""",
        "positive_pct",
    )
)
def delisting_label_share(spark, sf):
    """Positive share per delisting label."""
    prices, meta = _lifetimes(spark, sf)
    return ST.positive_share(S.delisting_labels(prices, meta), [f"delist_{h}d" for h in S.HORIZONS])


@query("SELECT c_mktsegment AS delist_reason, count(*) AS n FROM customer GROUP BY 1")
def reason_counts(spark, sf):
    """Value counts of delisting reasons."""
    return ST.value_counts(V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("delist_reason")), "delist_reason")


SEQ = f"""q AS (SELECT symbol, time, {chg('close')} AS f1, {roll('avg', 'close', 5)} AS f2,
  {lead('close', 1)} / close - 1 AS y FROM bars),
  c AS (SELECT *, row_number() OVER ({W}) - 1 AS t FROM q WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND y IS NOT NULL)"""


def _seq_frame(spark, sf):
    s = Series.of(V.weekly_layer(spark, sf), behind=5, ahead=1)
    s = s.with_columns(_p=s.back("close"), _n=s.ahead("close"), f2=s.mean("close", 5))
    return s.with_columns(f1=pct(F.col("close"), F.col("_p")), y=F.col("_n") / F.col("close") - 1).own()


@query(
    final(
        f"""(WITH {V.WEEKLY}, {SEQ} SELECT symbol, time, y, 60 AS steps,
        sum(f1) OVER p AS sum_f1, first_value(f2) OVER p AS first_f2, last_value(f2) OVER p AS last_f2
        FROM c WINDOW p AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY t >= 60)""",
        "y sum_f1 first_f2 last_f2",
    )
)
def sequence_windows(spark, sf):
    """Sequences of 60 complete rows with the following row's target."""
    x = S.sequences(_seq_frame(spark, sf), ["f1", "f2"], "y", 60)
    return x.select(
        "symbol",
        "time",
        "y",
        F.size("x").alias("steps"),
        F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0]).alias("sum_f1"),
        F.col("x")[0][1].alias("first_f2"),
        F.col("x")[59][1].alias("last_f2"),
    )


@query(
    final(
        f"""(WITH {V.WEEKLY}, c AS (SELECT *, row_number() OVER ({W}) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n,
        {", ".join(f"{lead('close', h)} / close - 1 AS r{h}" for h in range(1, 6))},
        sum(volume) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS volume_sum FROM bars)
        SELECT symbol, time, volume_sum::DOUBLE AS volume_sum, r1, r5, ({"+".join(f"{b(f'r{h} > 0')}" for h in range(1, 6))}) AS ups
        FROM c WHERE t >= 251 AND t + 6 <= n - 1)""",
        "volume_sum r1 r5 ups",
    )
)
def year_windows(spark, sf):
    """Windows of 252 rows with the next five returns."""
    x = S.windows(V.weekly_layer(spark, sf), ["volume"], 252, 5)
    return x.select(
        "symbol",
        "time",
        F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0]).alias("volume_sum"),
        F.col("target_returns")[0].alias("r1"),
        F.col("target_returns")[4].alias("r5"),
        F.aggregate("target_direction", F.lit(0.0), lambda a, r: a + r).alias("ups"),
    )


@query(
    final(
        f"""(WITH {LABELS}, c AS (SELECT *, row_number() OVER ({W}) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n,
        {lead('close', 1)} / close - 1 AS r1, sum(close) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close_sum FROM life)
        SELECT c.symbol, c.time, close_sum, r1, delist_30d::DOUBLE AS risk_30d, delist_365d::DOUBLE AS risk_365d,
        (SELECT count(DISTINCT o_custkey) FROM orders)::INTEGER AS stock_idx, true AS is_delisted
        FROM c JOIN delist d ON d.symbol = c.symbol AND d.date = c.time WHERE t >= 2 AND t + 3 <= n - 1)""",
        "close_sum r1 risk_30d risk_365d",
    )
)
def delisted_samples(spark, sf):
    """Windows of delisted symbols with their risk vector."""
    prices, meta = _lifetimes(spark, sf)
    labels = S.delisting_labels(prices, meta)
    n = V.table(spark, sf, "orders").agg(F.countDistinct("o_custkey").cast("int").alias("n")).scalar()
    x = S.delisted_windows(prices, labels, ["close"], 0, length=3, horizon=2, chunk="quarter")
    return x.select(
        "symbol",
        "time",
        F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0]).alias("close_sum"),
        F.col("target_returns")[0].alias("r1"),
        F.col("delist_risk")[0].alias("risk_30d"),
        F.col("delist_risk")[3].alias("risk_365d"),
        n.alias("stock_idx"),
        "is_delisted",
    )


@query(
    f"""WITH {V.WEEKLY}, {LIFE}, a AS (SELECT symbol, false AS is_delisted FROM bars UNION ALL SELECT symbol, true FROM life)
    SELECT is_delisted, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM a GROUP BY 1"""
)
def samples_with_delisted(spark, sf):
    """Live and delisted rows as one table with a flag."""
    prices, _ = _lifetimes(spark, sf)
    both = S.with_delisted(
        V.weekly_layer(spark, sf).select("symbol", "time", "close"), prices.withColumn("is_delisted", F.lit(True))
    )
    per = both.groupBy("is_delisted", "symbol").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("is_delisted").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_symbols"))


@query(
    """WITH s AS (SELECT DISTINCT concat('C', o_custkey) AS symbol FROM orders),
    r AS (SELECT symbol, row_number() OVER (ORDER BY md5(concat('42:', symbol)), symbol) - 1 AS t, count(*) OVER () AS n FROM s)
    SELECT symbol, CASE WHEN t < floor(n * 0.8) THEN 'train' WHEN t < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def symbol_split(spark, sf):
    """Seeded 80/10/10 split of the symbols."""
    return S.split_symbols(_lifetimes(spark, sf)[0])


@query(
    """WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)
    SELECT 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n_symbols FROM n UNION ALL
    SELECT 'val', CAST(floor(n * 0.1) AS BIGINT) FROM n UNION ALL
    SELECT 'test', CAST(n - floor(n * 0.8) - floor(n * 0.1) AS BIGINT) FROM n"""
)
def symbol_split_sizes(spark, sf):
    """Sizes of the symbol split."""
    return symbol_split.plain(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_symbols"))


@query(
    f"""WITH {V.WEEKLY}, d AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t, count(*) OVER () AS n
    FROM (SELECT DISTINCT time FROM bars)), cut AS (SELECT min(time) AS c FROM d WHERE t >= floor(n * 0.8))
    SELECT symbol, time, CASE WHEN time < c THEN 'train' ELSE 'val' END AS split FROM bars, cut"""
)
def time_split(spark, sf):
    """80/20 split by time."""
    return S.split_time(V.weekly_layer(spark, sf)).select("symbol", "time", "split")


@query(
    """SELECT symbol, CAST(dense_rank() OVER (ORDER BY symbol) - 1 AS INTEGER) AS stock_idx FROM
    (SELECT DISTINCT concat('C', o_custkey) AS symbol FROM orders)"""
)
def symbol_index(spark, sf):
    """Dense index of the symbols."""
    return S.symbol_index(_lifetimes(spark, sf)[0])


@query("SELECT concat('C', o_custkey) AS symbol, CAST(least(99, count(*) // 21) AS INTEGER) AS age_months FROM orders GROUP BY 1")
def stock_age(spark, sf):
    """Stock age in months from the row count."""
    o = V.table(spark, sf, "orders")
    per = o.groupBy(F.concat(F.lit("C"), "o_custkey").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("symbol", S.stock_age_months(F.col("n")).alias("age_months"))


NORM = ("returns", "momentum_5", "daily_range", "volume_ratio")
FEAT = f"""feat AS (SELECT symbol, time, close, {chg('close')} AS returns, {chg('close', 5)} AS momentum_5,
  (high - low) / close AS daily_range, volume / ({roll('avg', 'volume', 20)}) AS volume_ratio FROM bars)"""


def _features(spark, sf):
    return T.add_technical(V.weekly_layer(spark, sf), ema=False).select("symbol", "time", "close", *NORM)


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FEAT}, st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NORM)} FROM feat)
        SELECT symbol, time, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NORM)} FROM feat, st)""",
        " ".join(NORM),
    )
)
def normalized_features(spark, sf):
    """Z-scored features."""
    df = _features(spark, sf)
    return ST.apply_stats(df, ST.fit_stats(df, NORM), NORM).select("symbol", "time", *NORM)


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FEAT}, flat AS (SELECT *, 7.0::DOUBLE AS flat FROM feat),
        st AS (SELECT avg(returns) AS m, stddev_samp(returns) AS s FROM flat)
        SELECT symbol, time, coalesce((returns - m) / s, 0) AS returns, 0.0::DOUBLE AS flat, close FROM flat, st)""",
        "returns flat close",
    )
)
def normalized_live(spark, sf):
    """Live normalisation: no spread counts as 1, unknown columns stay, then non-finite values are replaced."""
    df = _features(spark, sf).withColumn("flat", F.lit(7.0))
    stats = ST.fit_stats(df, ["returns", "flat"])
    out = ST.apply_stats(df, stats, ["returns", "flat", "close"], style="live")
    return out.select("symbol", "time", finite(F.col("returns")).alias("returns"), "flat", "close")


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FEAT} {" UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) + 1e-8 AS std FROM feat" for c in NORM)})""",
        "mean std",
    )
)
def feature_stats(spark, sf):
    """Mean and population deviation per feature."""
    return ST.stats_long(_features(spark, sf), NORM)


@query(
    final(
        f"""(WITH {V.WEEKLY}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
        s AS (SELECT symbol, t AS i FROM n WHERE t < n - 252 - 5),
        x AS (SELECT n.close FROM s JOIN n ON n.symbol = s.symbol AND n.t BETWEEN s.i AND s.i + 251)
        SELECT 'close' AS feature, avg(close) AS mean, stddev_pop(close) + 1e-8 AS std FROM x)""",
        "mean std",
    )
)
def sample_stats(spark, sf):
    """Statistics over all sliding windows: each row weighs as often as it appears in a window."""
    rows = S.window_multiplicity(V.weekly_layer(spark, sf), 252, 5)
    return ST.stats_long(rows, ["close"], F.col("n_windows"))


PRED = f"""pred AS (SELECT symbol, time, {lead('close', 1)} / close - 1 AS y, {chg('close')} / 10 AS p FROM bars),
  pp AS (SELECT * FROM pred WHERE y IS NOT NULL AND p IS NOT NULL)"""


def _predictions(spark, sf):
    s = Series.of(V.weekly_layer(spark, sf), behind=1, ahead=1)
    s = s.with_columns(_p=s.back("close"), _n=s.ahead("close"))
    s = s.with_columns(y=F.col("_n") / F.col("close") - 1, p=pct(F.col("close"), F.col("_p")) / 10)
    return s.own().filter(F.col("y").isNotNull() & F.col("p").isNotNull())


@query(
    final(
        f"""(WITH {V.WEEKLY}, {PRED} SELECT symbol, avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae,
        corr(y, p) AS correlation, avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END) AS direction_accuracy FROM pp GROUP BY 1)""",
        "mse rmse mae correlation direction_accuracy",
    )
)
def prediction_metrics(spark, sf):
    """Regression metrics of a naive momentum prediction."""
    return M.regression_metrics(_predictions(spark, sf), by=("symbol",))


@query(
    final(
        f"""(WITH {V.WEEKLY}, w AS (SELECT symbol, time, {chg('close')} AS p, {", ".join(f"{lead('close', h)} / close - 1 AS y{h}" for h in range(1, 6))} FROM bars),
        l AS (SELECT h AS day, p * h AS p, CASE h WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 WHEN 4 THEN y4 ELSE y5 END AS y
              FROM w, range(1, 6) r(h) WHERE y5 IS NOT NULL AND p IS NOT NULL)
        SELECT day::INTEGER AS day, coalesce(corr(y, p), 0) AS correlation, avg(CASE WHEN (y > 0) = (p > 0) THEN 1.0 ELSE 0.0 END) AS direction_accuracy
        FROM l GROUP BY 1)""",
        "correlation direction_accuracy",
    )
)
def horizon_metrics(spark, sf):
    """Correlation and direction accuracy per forecast day."""
    s = Series.of(V.weekly_layer(spark, sf), behind=1, ahead=5)
    s = s.with_columns(_p=s.back("close"), **{f"_y{h}": s.ahead("close", h) for h in range(1, 6)})
    s = s.with_columns(_p=pct(F.col("close"), F.col("_p")))
    df = s.own().filter(F.col("_p").isNotNull() & F.col("_y5").isNotNull())
    df = df.select(
        F.array(*(F.col(f"_y{h}") / F.col("close") - 1 for h in range(1, 6))).alias("y"),
        F.array(*(F.col("_p") * h for h in range(1, 6))).alias("p"),
    )
    return M.horizon_metrics(df)


@query(
    final(
        f"""(WITH {V.WEEKLY}, {PRED}, l AS (SELECT y, p AS mu, 0.05::DOUBLE + abs(p) AS sigma, 1 / (1 + exp(-p)) AS dp,
        {b('y < -0.5')} AS dy, symbol = 'NATION_3' AS d FROM pp),
        p AS (SELECT avg((mu - y) ** 2) AS price_mse,
        avg(CASE WHEN mu > 0 THEN mu ELSE 0 END - mu * {b('y > 0')} + ln(1 + exp(-abs(mu)))) AS direction_bce,
        avg(ln(sigma + 1e-8) + (mu - y) ** 2 / (2 * sigma ** 2 + 1e-8)) AS uncertainty_nll,
        avg(CASE WHEN d THEN 5 ELSE 1 END * -(dy * CASE WHEN dp <= 0 THEN -100 ELSE greatest(-100, ln(dp)) END + (1 - dy) * CASE WHEN dp >= 1 THEN -100 ELSE greatest(-100, ln(1 - dp)) END)) AS delist_bce FROM l)
        SELECT *, price_mse + 0.5 * direction_bce + 0.2 * uncertainty_nll + 0.5 * delist_bce AS total_loss FROM p)""",
        "price_mse direction_bce uncertainty_nll delist_bce total_loss",
    )
)
def loss_metrics(spark, sf):
    """Loss parts on a prediction table."""
    p = _predictions(spark, sf)
    df = p.select(
        "y",
        F.col("p").alias("mu"),
        (F.abs("p") + 0.05).alias("sigma"),
        (1 / (1 + F.exp(-F.col("p")))).alias("delist_p"),
        F.when(F.col("y") < -0.5, 1.0).otherwise(0.0).alias("delist_y"),
        (F.col("symbol") == "NATION_3").alias("is_delisted"),
    )
    return M.loss_metrics(df)


@query(
    final(
        f"""(WITH {V.WEEKLY}, r AS (SELECT symbol, time, {chg('close')} / 100 AS r FROM bars), g AS (SELECT * FROM r WHERE r IS NOT NULL),
        w AS (SELECT *, sum(ln(1 + r)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS l FROM g),
        d AS (SELECT *, 1 - exp(l - greatest(0, max(l) OVER ({W} ROWS UNBOUNDED PRECEDING))) AS dd FROM w)
        SELECT symbol, exp(sum(ln(1 + r))) - 1 AS total_return, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe_ratio,
        avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
        sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END) AS profit_factor, max(dd) AS max_drawdown FROM d GROUP BY 1)""",
        "total_return sharpe_ratio win_rate profit_factor max_drawdown",
    )
)
def portfolio_metrics(spark, sf):
    """Portfolio metrics of the weekly returns (scaled down to daily size)."""
    s = Series.of(V.weekly_layer(spark, sf), behind=1)
    s = s.with_columns(_p=s.back("close"))
    r = s.own().select("symbol", "time", (pct(F.col("close"), F.col("_p")) / 100).alias("r"))
    return M.portfolio_metrics(r)


@query(
    final(
        """(WITH t AS (SELECT o_custkey AS symbol, o_orderdate AS opened_at, l_shipdate AS closed_at,
             l_extendedprice * (l_discount - l_tax) AS pnl FROM orders JOIN lineitem ON o_orderkey = l_orderkey
             WHERE l_shipdate >= o_orderdate)
        SELECT symbol, avg(date_diff('second', opened_at, closed_at)) / 86400 AS avg_trade_duration,
        avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
        sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0) AS profit_factor FROM t GROUP BY 1)""",
        "avg_trade_duration win_rate profit_factor",
    )
)
def trade_metrics(spark, sf):
    """Duration, win rate and profit factor of closed trades."""
    t = V.table(spark, sf, "orders").join(V.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    t = t.filter(F.col("l_shipdate") >= F.col("o_orderdate")).select(
        F.col("o_custkey").alias("symbol"),
        F.col("o_orderdate").alias("opened_at"),
        F.col("l_shipdate").alias("closed_at"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
    )
    return M.trade_metrics(t)


@query(
    final(
        f"""(WITH {V.WEEKLY}, f AS (SELECT {chg('close', 20)} AS momentum_20, {roll('avg', 'close', 50)} AS sma_50,
           {roll('avg', 'close', 200)} AS sma_200, close FROM bars),
        n AS (SELECT avg({b('momentum_20 IS NULL')}) * 100 AS a, avg({b('sma_50 IS NULL')}) * 100 AS b, avg({b('sma_200 IS NULL')}) * 100 AS c,
           avg({b('close IS NULL')}) * 100 AS d FROM f),
        l AS (SELECT 'momentum_20' AS column_name, a AS null_pct FROM n UNION ALL SELECT 'sma_50', b FROM n
              UNION ALL SELECT 'sma_200', c FROM n UNION ALL SELECT 'close', d FROM n)
        SELECT *, CASE WHEN null_pct < 5 THEN 'OK' WHEN null_pct < 20 THEN 'WARN' ELSE 'ERROR' END AS status FROM l)""",
        "null_pct",
    )
)
def null_quality(spark, sf):
    """Null share per feature with its grade."""
    df = T.add_technical(V.weekly_layer(spark, sf), ema=False)
    return ST.null_share(df, ["momentum_20", "sma_50", "sma_200", "close"])


@query(
    final(
        f"""(WITH {V.WEEKLY} {" UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM bars" for c in ("close", "volume", "vwap"))})""",
        "mean std min max",
    )
)
def column_summary(spark, sf):
    """Mean, deviation and range per column."""
    return ST.summary(V.weekly_layer(spark, sf), ["close", "volume", "vwap"])


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FEAT}, runs AS (SELECT symbol, count(*) AS "rows", 4 AS cols, avg({b('volume_ratio IS NULL')}) * 100 AS null_pct
          FROM feat GROUP BY 1), st AS (SELECT *, CASE WHEN "rows" < 300 THEN 'skipped' ELSE 'success' END AS status FROM runs)
        SELECT status, count(*) AS n, avg("rows") AS mean_rows, avg(cols) AS mean_cols, avg(null_pct) AS mean_null_pct FROM st GROUP BY 1)""",
        "mean_rows mean_cols mean_null_pct",
    )
)
def run_summary(spark, sf):
    """Per-symbol processing runs, counted by status."""
    runs = _features(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(NORM)).alias("cols"),
        (F.avg(F.col("volume_ratio").isNull().cast("double")) * 100).alias("null_pct"),
    )
    return ST.status_summary(runs.withColumn("status", F.when(F.col("rows") < 300, "skipped").otherwise("success")))


@query(
    final(
        f"""(WITH {V.WEEKLY}, {V.BENCH}, {FLOW}, {PROXY}
        SELECT p5.symbol, p5.time, {chg('close')} AS returns, coalesce(sp, 0) AS sentiment_proxy, smart_money_flow, retail_flow,
        (high - low) / close AS daily_range, (high - low) / open AS sent_daily_range
        FROM p5 JOIN flow USING (symbol, time))""",
        "returns sentiment_proxy smart_money_flow retail_flow daily_range sent_daily_range",
    )
)
def all_families(spark, sf):
    """Technical, sentiment and flow families of every symbol in one job."""
    df = FA.add_all(V.weekly_layer(spark, sf), V.benchmark_layer(spark, sf))
    return df.select(
        "symbol", "time", "returns", "sentiment_proxy", "smart_money_flow", "retail_flow", "daily_range", "sent_daily_range"
    )


@query(
    final(
        f"""(WITH {V.WEEKLY}, a AS (SELECT *, {roll('avg', 'close', 200)} AS s200, {chg('close', 20)} AS momentum_20,
          {lead('close', 5)} / close - 1 AS target_return_5d FROM bars)
        SELECT symbol, time, momentum_20, target_return_5d FROM a WHERE s200 IS NOT NULL AND target_return_5d IS NOT NULL)""",
        "momentum_20 target_return_5d",
    )
)
def training_frame(spark, sf):
    """Technical features with targets; rows with a gap in the named columns are dropped."""
    df = S.add_targets(T.add_technical(V.weekly_layer(spark, sf)))
    df = FA.drop_incomplete(df, ["sma_200", "momentum_20", "target_return_5d"])
    return df.select("symbol", "time", "momentum_20", "target_return_5d")


@query(
    final(
        f"""(WITH {V.WEEKLY}, {FEAT} SELECT symbol, time, 16 AS width, coalesce(volume_ratio, 0) AS second, 0.0::DOUBLE AS last,
        coalesce(returns, 0) AS filled FROM feat)""",
        "second last filled",
    )
)
def feature_vectors(spark, sf):
    """Padded, finite feature vectors and zero-filled columns."""
    df = FA.vectors(T.add_technical(V.weekly_layer(spark, sf), ema=False))
    df = FA.zero_filled(df, ["returns"])
    return df.select(
        "symbol",
        "time",
        F.size("market_features").alias("width"),
        F.col("market_features")[1].alias("second"),
        F.col("market_features")[15].alias("last"),
        F.col("returns").alias("filled"),
    )
