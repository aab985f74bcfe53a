"""Technical indicators on bars: the research style (null until a window fills) and the live style."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import fdiv, flag, pct, ratio
from barloom.functions.series import Series, ewm_term, span_term
from barloom.operators.latest import last_n

BEHIND = 200
SPANS = (5, 10, 20, 50, 200)

# The model input columns, in order.
FEATURES = (
    "returns",
    "log_returns",
    "price_sma_20_ratio",
    "price_sma_50_ratio",
    "bb_width",
    "bb_position",
    "rsi_14",
    "macd",
    "macd_signal",
    "macd_histogram",
    "atr_14",
    "volatility_20",
    "volume_ratio",
    "momentum_1",
    "momentum_5",
    "momentum_10",
    "momentum_20",
    "daily_range",
    "position_in_range",
    "gap",
)


def windows(s: Series) -> Series:
    """Everything with a fixed look-back: averages, bands, RSI, ATR, momentum, ranges, gaps."""
    c = F.col
    s = s.with_columns(
        _prev=s.back("close"),
        sma_5=s.mean("close", 5),
        sma_10=s.mean("close", 10),
        sma_20=s.mean("close", 20),
        bb_std=s.std("close", 20),
        volume_sma_20=s.mean("volume", 20),
        high_20=s.roll(F.max, "high", 20),
        low_20=s.roll(F.min, "low", 20),
        _c5=s.back("close", 5),
        _c10=s.back("close", 10),
        _c20=s.back("close", 20),
    )
    s = s.long_mean({"sma_50": ("close", 50), "sma_200": ("close", 200)})
    step = c("close") - c("_prev")
    s = s.with_columns(
        returns=pct(c("close"), c("_prev")),
        log_returns=F.ln(ratio(c("close"), c("_prev"))),
        momentum_1=pct(c("close"), c("_prev")),
        momentum_5=pct(c("close"), c("_c5")),
        momentum_10=pct(c("close"), c("_c10")),
        momentum_20=pct(c("close"), c("_c20")),
        gap=pct(c("open"), c("_prev")),
        _gain=F.when(step > 0, step).otherwise(0.0),
        _loss=F.when(step < 0, -step).otherwise(0.0),
        _tr=F.greatest(
            c("high") - c("low"), F.abs(c("high") - c("_prev")), F.abs(c("low") - c("_prev"))
        ),
    )
    s = s.with_columns(
        _gain=s.mean("_gain", 14),
        _loss=s.mean("_loss", 14),
        atr_14=s.mean("_tr", 14),
        volatility_20=s.std("returns", 20) * math.sqrt(252),
        price_sma_20_ratio=fdiv(c("close"), c("sma_20")),
        price_sma_50_ratio=fdiv(c("close"), c("sma_50")),
        bb_middle=c("sma_20"),
        bb_upper=c("sma_20") + 2 * c("bb_std"),
        bb_lower=c("sma_20") - 2 * c("bb_std"),
        volume_ratio=fdiv(c("volume"), c("volume_sma_20")),
        daily_range=fdiv(c("high") - c("low"), c("close")),
        position_in_range=fdiv(c("close") - c("low_20"), c("high_20") - c("low_20")),
    )
    s = s.with_columns(
        bb_width=fdiv(c("bb_upper") - c("bb_lower"), c("bb_middle")),
        bb_position=fdiv(c("close") - c("bb_lower"), c("bb_upper") - c("bb_lower")),
        # no losses: 100; no change at all: null
        rsi_14=F.when(c("_loss") > 0, 100 - 100 / (1 + c("_gain") / c("_loss"))).when(
            c("_gain") > 0, F.lit(100.0)
        ),
    )
    return s.drop("_prev", "_gain", "_loss", "_tr", "_c5", "_c10", "_c20")


ALL_SPANS = sorted({*SPANS, 9, 12, 26})


def specs() -> dict:
    """Running averages the family needs, for ``Series.accumulate``."""
    return {f"ema_{n}": span_term("close", n) for n in ALL_SPANS}


def smoothed(n: int, m: int = 9):
    """Average of span m over the average of span n, from the plain averages of both spans."""
    p, q = 1 - 2 / (n + 1), 1 - 2 / (m + 1)
    return ((1 - q) * p / (p - q)) * F.col(f"ema_{n}") - ((1 - p) * q / (p - q)) * F.col(f"ema_{m}")


def finish(s: Series) -> Series:
    """MACD columns from the accumulated averages.

    The signal line is an average (span 9) of a difference of averages (spans 12 and 26). Averaging
    an average of span n again with span m gives, for p = 1 - 2/(n+1) and q = 1 - 2/(m+1),
    ``((1-q) p E_n - (1-p) q E_m) / (p - q)``; so E_9 of the close is all that is needed besides.
    """
    e = {n: F.col(f"ema_{n}") for n in ALL_SPANS}
    s = s.with_columns(macd=e[12] - e[26], macd_signal=smoothed(12) - smoothed(26))
    s = s.with_columns(macd_histogram=F.col("macd") - F.col("macd_signal"))
    return s.drop(*(f"ema_{n}" for n in ALL_SPANS if n not in SPANS))


def recursive(s: Series) -> Series:
    """Exponential averages and MACD, with one carry over block borders."""
    return finish(s.accumulate(specs()))


def add_technical(bars: DataFrame, *, ema: bool = True, **how) -> DataFrame:
    """Bars with the whole technical family. ``how`` goes to ``Series.of``."""
    s = windows(Series.of(bars, behind=BEHIND, **how))
    return (recursive(s) if ema else s).own()


def add_exponential(bars: DataFrame, **how) -> DataFrame:
    """Bars with exponential averages and MACD only."""
    return recursive(Series.of(bars, behind=0, **how)).own()


def add_trend(bars: DataFrame, **how) -> DataFrame:
    """Trend against the 200-row average, 20-row momentum and the 0-based row counter."""
    s = Series.of(bars, behind=BEHIND, **how).long_mean({"sma_200": ("close", 200)})
    s = s.with_columns(_c20=s.back("close", 20))
    s = s.with_columns(
        trend=F.when(F.col("close") > F.col("sma_200"), 1).otherwise(-1),
        momentum=pct(F.col("close"), F.col("_c20")),
        days_listed=F.col("_t"),
    )
    return s.drop("_c20").own()


def add_downloader_style(bars: DataFrame, **how) -> DataFrame:
    """The same indicators under the names of the history layer, with trend and row counter."""
    s = recursive(windows(Series.of(bars, behind=BEHIND, **how)))
    c = F.col
    return s.with_columns(
        volatility_20d=c("volatility_20"),
        volume_ma_20=c("volume_sma_20"),
        price_to_sma50=c("price_sma_50_ratio"),
        price_to_sma200=fdiv(c("close"), c("sma_200")),
        rsi=c("rsi_14"),
        atr=c("atr_14"),
        trend=F.when(c("close") > c("sma_200"), 1).otherwise(-1),
        momentum=c("momentum_20"),
        days_listed=c("_t"),
    ).own()


def add_live(bars: DataFrame, **how) -> DataFrame:
    """Live-style indicators: defined on every row, with neutral values before a window fills."""
    c, t = F.col, F.col("_t")
    s = Series.of(bars, behind=30, **how)
    s = s.with_columns(_prev=s.back("close"), _next=s.ahead("close"))
    step = c("close") - c("_prev")
    tr = F.greatest(c("high") - c("low"), F.abs(c("high") - c("_prev")), F.abs(c("low") - c("_prev")))
    s = s.with_columns(
        returns=F.when(c("_prev") > 0, step / c("_prev")).otherwise(0.0),
        _gain=F.when(step > 0, step).otherwise(0.0),
        _loss=F.when(step < 0, -step).otherwise(0.0),
        _tr=F.when((t == 0) & c("_next").isNull(), 0.0).otherwise(tr),
        _flow=F.when(t == 0, c("volume"))
        .when(step > 0, c("volume"))
        .when(step < 0, -c("volume"))
        .otherwise(0)
        .cast("double"),
    )
    s = s.with_columns(
        _mid=F.avg("close").over(s.rows(20)),
        _dev=2 * F.stddev_pop("close").over(s.rows(20)),
        _v20=F.avg("volume").over(s.rows(20)),
        **{f"_c{n}": s.back("close", n) for n in (5, 10, 20)},
    )
    warm = t >= 19
    s = s.with_columns(
        log_returns=F.log1p("returns"),
        bb_mid=F.when(warm, c("_mid")).otherwise(c("close")),
        bb_upper=F.when(warm, c("_mid") + c("_dev")).otherwise(c("close")),
        bb_lower=F.when(warm, c("_mid") - c("_dev")).otherwise(c("close")),
        atr=F.when(t >= 13, F.avg("_tr").over(s.rows(14))).otherwise(c("_tr")),
        volume_ratio=F.when(warm & (c("_v20") > 0), c("volume") / c("_v20")).otherwise(1.0),
        # seeds of the smoothed gains and losses sit on the row where 14 changes are there
        _gain=F.when(t == 14, F.avg("_gain").over(s.rows(14))).otherwise(c("_gain")),
        _loss=F.when(t == 14, F.avg("_loss").over(s.rows(14))).otherwise(c("_loss")),
        **{
            f"momentum_{n}": F.when(c(f"_c{n}") > 0, c("close") / c(f"_c{n}") - 1).otherwise(0.0)
            for n in (5, 10, 20)
        },
        **{
            f"volatility_{n}": F.when(t >= n, F.stddev_pop("returns").over(s.rows(n))).otherwise(0.0)
            for n in (5, 10, 20)
        },
    )
    s = s.accumulate(
        {
            "ema_9": span_term("close", 9),
            "ema_12": span_term("close", 12),
            "ema_26": span_term("close", 26),
            "_up": ewm_term("_gain", 1 / 14, start=14),
            "_down": ewm_term("_loss", 1 / 14, start=14),
            "obv": (c("_flow"), 1.0),
        }
    )

    before = c("obv") - c("_flow")
    band = c("bb_upper") - c("bb_lower")
    s = s.with_columns(
        rsi=F.when(t < 14, 50.0)
        .when(c("_down") < 1e-10, 100.0)
        .otherwise(100 - 100 / (1 + c("_up") / c("_down"))),
        macd=c("ema_12") - c("ema_26"),
        macd_signal=smoothed(12) - smoothed(26),
        bb_width=ratio(band, c("bb_mid")),
        bb_pct=F.when(band > 0, (c("close") - c("bb_lower")) / band).otherwise(0.5),
        atr_pct=F.when(c("close") > 0, c("atr") / c("close")).otherwise(0.0),
        obv_change=F.when((t > 0) & (before != 0), c("_flow") / F.abs(before)).otherwise(0.0),
    ).with_columns(macd_hist=c("macd") - c("macd_signal"))
    return s.drop(
        "_prev", "_next", "_gain", "_loss", "_tr", "_flow", "_up", "_down", "ema_9", "ema_12", "ema_26",
        "_mid", "_dev", "_v20", "_c5", "_c10", "_c20",
    ).own()


def live_window(bars: DataFrame, sequence: int = 60, **how) -> DataFrame:
    """Live features of the newest ``sequence`` bars, as the live scorer sees them.

    It keeps sequence + 50 bars per symbol, so averages start there; a symbol with fewer than
    sequence + 20 bars is not ready and left out. ``age`` 1 is the newest bar.
    """
    kept = last_n(bars.drop("_t"), sequence + 50, order=("time",))
    enough = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= sequence + 20)
    ready = kept.join(enough.select("symbol"), "symbol", "left_semi")
    return add_live(ready, staged=True, **how).filter(F.col("age") <= sequence)


LIVE_FEATURES = (
    "returns log_returns rsi macd macd_signal macd_hist bb_upper bb_mid bb_lower bb_width bb_pct atr atr_pct "
    "obv_change momentum_5 momentum_10 momentum_20 volatility_5 volatility_10 volatility_20 volume_ratio"
).split()


def add_beta(bars: DataFrame, market: DataFrame, n: int = 60, **how) -> DataFrame:
    """Beta against a market series over the last n common rows (n is our choice)."""
    from barloom.operators.proxy import own_returns

    mine = own_returns(bars, "r", **how)
    theirs = own_returns(market, "m", **how).select("time", "m")
    s = Series.of(mine.join(theirs, "time"), behind=n, staged=True, **how)
    frame = s.rows(n)
    both = flag(F.col("r").isNotNull() & F.col("m").isNotNull())
    s = s.with_columns(_both=both)
    s = s.with_columns(
        _full=F.sum("_both").over(frame) == n,
        _cov=F.covar_samp("r", "m").over(frame),
        _var=F.var_samp("m").over(frame),
    )
    s = s.with_columns(beta=F.when(F.col("_full"), ratio(F.col("_cov"), F.col("_var"))))
    return s.drop("_both", "_full", "_cov", "_var", "r", "m").own()
