"""Signal fusion, actions, sizing, risk rules, positions and market hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.functions.series import Series

# Weights of the technical, prediction and sentiment signals per market regime.
REGIME_WEIGHTS = {
    "trending": (0.30, 0.50, 0.20),
    "mean_reverting": (0.50, 0.30, 0.20),
    "high_volatility": (0.25, 0.25, 0.50),
    "low_volatility": (0.40, 0.40, 0.20),
}
DEFAULT_WEIGHTS = (0.35, 0.40, 0.25)

# Bounds of the actions.
ACTIONS = {"STRONG_BUY": 0.7, "BUY": 0.3, "SELL": -0.3, "STRONG_SELL": -0.7}

# Risk limits.
LIMITS = {
    "max_position_pct": 0.10,
    "max_position_value": 50_000.0,
    "max_sector_exposure": 0.30,
    "max_total_exposure": 0.80,
    "min_cash_reserve": 0.20,
    "max_open_positions": 20,
    "daily_loss_limit_pct": 0.02,
    "stop_loss_pct": 0.05,
    "trailing_stop_pct": 0.03,
    "high_vix_reduction": 0.50,
    "vix_threshold": 30.0,
}


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def regime_weight(regime: Column, i: int) -> Column:
    """Weight i (0 technical, 1 prediction, 2 sentiment) of a regime; any other regime is balanced."""
    out = None
    for name, w in REGIME_WEIGHTS.items():
        cond = F.lower(regime) == name
        out = F.when(cond, w[i]) if out is None else out.when(cond, w[i])
    return out.otherwise(DEFAULT_WEIGHTS[i])


def assemble(screener: DataFrame, prediction: DataFrame, sentiment: DataFrame) -> DataFrame:
    """One row per (symbol, time) with the screener score, the prediction and, where known, sentiment."""
    return screener.join(prediction, ["symbol", "time"]).join(sentiment, ["symbol", "time"], "left")


def fuse(df: DataFrame) -> DataFrame:
    """Component signals in [-1, 1] and their regime-weighted sum.

    Input: technical (any scale, squashed by tanh: our choice), trend_probability, weighted_sentiment
    (missing counts as neutral), regime.
    """
    out = df.withColumns(
        {
            "technical_signal": F.tanh("technical"),
            "prediction_signal": F.col("trend_probability") * 2 - 1,
            "sentiment_signal": F.coalesce("weighted_sentiment", F.lit(0.0)),
        }
    )
    r = F.col("regime")
    return out.withColumn(
        "composite_signal",
        regime_weight(r, 0) * F.col("technical_signal")
        + regime_weight(r, 1) * F.col("prediction_signal")
        + regime_weight(r, 2) * F.col("sentiment_signal"),
    )


def action(signal: Column) -> Column:
    """Action by thresholds; a signal exactly at a bound takes the stronger action (our choice)."""
    return (
        F.when(signal >= ACTIONS["STRONG_BUY"], "STRONG_BUY")
        .when(signal >= ACTIONS["BUY"], "BUY")
        .when(signal <= ACTIONS["STRONG_SELL"], "STRONG_SELL")
        .when(signal <= ACTIONS["SELL"], "SELL")
        .otherwise("HOLD")
    )


def dashboard_signal(technical: Column, model: Column, sentiment: Column) -> dict[str, Column]:
    """The dashboard's 0..1 composite and its signal."""
    mix = technical * 0.4 + model * 0.4 + sentiment * 0.2
    return {"composite": mix, "signal": F.when(mix > 0.6, "BUY").when(mix < 0.4, "SELL").otherwise("HOLD")}


def position_size(signal: Column, confidence: Column, expected_return: Column, volatility: Column) -> Column:
    """Half-Kelly share of the portfolio, 0 to 10 percent, scaled by confidence. Null without volatility."""
    win = clamp(0.5 + signal * 0.25 * confidence, 0.3, 0.7)
    edge = clamp(ratio(expected_return, volatility), 0.5, 3.0)
    kelly = (win * edge - (1 - win)) / edge
    return clamp(kelly * 0.5, 0.0, 0.10) * confidence


def risk_columns(df: DataFrame) -> DataFrame:
    """Size, Sharpe estimate, action, stop loss and take profit of fused signals.

    Stops sit 5 percent from the price against the trade; the profit target twice as far (our choice).
    """
    s, p = F.col("composite_signal"), F.col("price")
    stop = LIMITS["stop_loss_pct"]
    side = F.when(s >= 0, 1.0).otherwise(-1.0)
    return df.withColumns(
        {
            "position_size": position_size(s, F.col("confidence"), F.col("expected_return"), F.col("volatility")),
            "sharpe_estimate": ratio(F.col("expected_return"), F.col("volatility")),
            "action": action(s),
            "stop_loss": p * (1 - side * stop),
            "take_profit": p * (1 + side * 2 * stop),
        }
    )


def exposures(positions: DataFrame) -> DataFrame:
    """Value per portfolio and sector with the portfolio's total (positions: portfolio, sector, value)."""
    per = positions.groupBy("portfolio", "sector").agg(F.sum("value").alias("sector_value"))
    # one row per sector is left by now
    return per.withColumn("total_exposure", F.sum("sector_value").over(Window.partitionBy("portfolio")))


def validate_orders(orders: DataFrame, portfolios: DataFrame, sector_values: DataFrame) -> DataFrame:
    """Decision, reason and adjusted quantity per order.

    orders: portfolio, sector, value, quantity. portfolios: portfolio, total_value, daily_pnl, vix.
    The first rule that fails is the reason: position, sector, daily loss. A high volatility index
    halves the quantity of what remains.
    """
    k = LIMITS
    held = sector_values.select("portfolio", "sector", "sector_value")
    df = orders.join(portfolios, "portfolio").join(held, ["portfolio", "sector"], "left")
    share = ratio(F.col("value"), F.col("total_value"))
    sector = ratio(F.coalesce("sector_value", F.lit(0.0)) + F.col("value"), F.col("total_value"))
    loss = ratio(F.col("daily_pnl"), F.col("total_value"))
    reason = (
        F.when(share > k["max_position_pct"], "Position size exceeds limit")
        .when(sector > k["max_sector_exposure"], "Sector exposure exceeds limit")
        .when(loss < -k["daily_loss_limit_pct"], "Daily loss limit reached")
    )
    cut = F.when(F.col("vix") > k["vix_threshold"], F.floor(F.col("quantity") * (1 - k["high_vix_reduction"])))
    df = df.withColumn("reason", reason)
    return df.withColumns(
        {
            "decision": F.when(F.col("reason").isNull(), "APPROVED").otherwise("REJECTED"),
            "adj_quantity": F.when(F.col("reason").isNull(), F.coalesce(cut, F.col("quantity"))).otherwise(0).cast("long"),
        }
    )


def portfolio_caps(df: DataFrame) -> DataFrame:
    """Flags per portfolio row: largest position, open positions, invested share, cash reserve."""
    k = LIMITS
    return df.withColumns(
        {
            "position_ok": F.col("max_value") <= k["max_position_value"],
            "count_ok": F.col("n_positions") <= k["max_open_positions"],
            "invested_ok": F.col("invested") <= F.col("total_value") * k["max_total_exposure"],
            "cash_ok": F.col("total_value") - F.col("invested") >= F.col("total_value") * k["min_cash_reserve"],
        }
    )


def trailing_stops(bars: DataFrame, entries: DataFrame, **how) -> DataFrame:
    """Fixed and trailing stop per bar since entry, and whether the bar's low touches one.

    ``entries``: symbol, entry_time, entry_price, one open position per symbol.
    """
    k = LIMITS
    held = bars.join(entries, "symbol").filter(F.col("time") >= F.col("entry_time"))
    s = Series.of(held, behind=0, **how).running_max("_peak", "high")
    s = s.with_columns(
        fixed_stop=F.col("entry_price") * (1 - k["stop_loss_pct"]),
        trailing_stop=F.col("_peak") * (1 - k["trailing_stop_pct"]),
    )
    return s.with_columns(hit=F.col("low") <= F.greatest("fixed_stop", "trailing_stop")).drop("_peak").own()


def position_pnl(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value, unrealised profit and profit percent (0 without cost) at the latest price."""
    df = positions.join(prices.select("symbol", F.col("close").alias("current_price")), "symbol", "left")
    gain = (F.col("current_price") - F.col("avg_cost")) * F.col("quantity")
    cost = F.col("avg_cost") * F.col("quantity")
    return df.withColumns(
        {
            "market_value": F.col("quantity") * F.col("current_price"),
            "unrealized_pnl": gain,
            "pnl_pct": F.when(cost > 0, gain / cost * 100).otherwise(0.0),
        }
    )


def _clock(time: Column, zone: str) -> tuple[Column, Column]:
    local = F.from_utc_timestamp(time, zone)
    return F.dayofweek(local), F.hour(local) * 60 + F.minute(local)


def market_status(time: Column, zone: str = "America/New_York") -> Column:
    """CLOSED on weekends, else PRE_MARKET before 9:30, AFTER_HOURS from 16:00, OPEN between."""
    day, minute = _clock(time, zone)
    return (
        F.when(day.isin(1, 7), "CLOSED").when(minute < 570, "PRE_MARKET").when(minute >= 960, "AFTER_HOURS").otherwise("OPEN")
    )


def is_market_hours(time: Column, zone: str = "America/New_York") -> Column:
    """Weekday between 9:30 and 16:00."""
    day, minute = _clock(time, zone)
    return ~day.isin(1, 7) & (minute >= 570) & (minute < 960)
