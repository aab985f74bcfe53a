"""Sentiment derived from price and volume, for times without news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import clip, fdiv, flag, pct
from barloom.functions.series import Series

BEHIND = 30

# The family's columns, in order. Its own range (over the open) is sent_daily_range.
FEATURES = (
    "overnight_gap",
    "gap_direction",
    "gap_magnitude",
    "large_gap_up",
    "large_gap_down",
    "gap_reversal",
    "volume_surprise",
    "bullish_volume",
    "bearish_volume",
    "range_expansion",
    "fear_signal",
    "close_position",
    "excess_return",
    "relative_strength",
    "momentum_divergence",
    "sentiment_proxy",
    "sentiment_proxy_smooth",
)


def own_returns(bars: DataFrame, name: str, **how) -> DataFrame:
    """symbol, time and the return against the previous own row."""
    t = [c for c in ("_t",) if c in bars.columns]
    s = Series.of(bars.select("symbol", "time", "close", *t), behind=1, **how)
    s = s.with_columns(_before=s.back("close"))
    return s.with_columns(**{name: pct(F.col("close"), F.col("_before"))}).own(keep_t=False).drop("close", "_before")


def relative_to_market(bars: DataFrame, market: DataFrame, n: int = 20, **how) -> DataFrame:
    """Excess return and n-row relative strength against a market series.

    Returns are taken on each series' own rows, then the times both have are kept, and the product
    window runs over those. One row per bar that has a market row. The joined returns (four columns) are
    staged, because they are counted and ranked anew.
    """
    mine = own_returns(bars, "_r", **how)
    theirs = own_returns(market, "_m", **how).select("time", "_m")
    s = Series.of(mine.join(theirs, "time"), behind=n, staged=True, **how)
    s = s.with_columns(
        excess_return=F.col("_r") - F.col("_m"),
        _lr=F.when(F.col("_r") > -1, F.log1p("_r")),
        _lm=F.when(F.col("_m") > -1, F.log1p("_m")),
    )
    strength = F.exp(s.roll(F.sum, "_lr", n)) / F.exp(s.roll(F.sum, "_lm", n)) - 1
    return s.with_columns(relative_strength=strength).own().drop("_r", "_m", "_lr", "_lm")


def windows(s: Series) -> Series:
    """The proxy family on a series that may carry excess_return and relative_strength."""
    c = F.col
    relative = "excess_return" in s.df.columns
    s = s.with_columns(
        _prev=s.back("close"),
        _v20=s.mean("volume", 20),
        sent_daily_range=fdiv(c("high") - c("low"), c("open")),
        close_position=(c("close") - c("low")) / (c("high") - c("low") + 1e-8),
        _c5=s.back("close", 5),
        _v5=s.back("volume", 5),
    )
    s = s.with_columns(_r20=s.mean("sent_daily_range", 20))
    s = s.with_columns(
        overnight_gap=fdiv(c("open") - c("_prev"), c("_prev")),
        volume_surprise=(c("volume") - c("_v20")) / (c("_v20") + 1e-8),
        range_expansion=fdiv(c("sent_daily_range"), c("_r20")),
        momentum_divergence=pct(c("close"), c("_c5")) / (F.abs(pct(c("volume"), c("_v5"))) + 0.01),
    )
    up, down = c("close") > c("open"), c("close") < c("open")
    s = s.with_columns(
        gap_direction=F.signum("overnight_gap"),
        gap_magnitude=F.abs("overnight_gap"),
        large_gap_up=flag(c("overnight_gap") > 0.02),
        large_gap_down=flag(c("overnight_gap") < -0.02),
        gap_reversal=-c("overnight_gap") * fdiv(c("close") - c("open"), c("open")),
        bullish_volume=c("volume_surprise") * flag(up),
        bearish_volume=c("volume_surprise") * flag(down),
        fear_signal=c("range_expansion") * flag(down),
    )
    excess = clip(c("excess_return"), -0.05, 0.05) * 20 if relative else F.lit(0.0)
    s = s.with_columns(
        sentiment_proxy=0.2 * clip(c("overnight_gap"), -0.1, 0.1) * 10
        + 0.2 * (c("close_position") * 2 - 1)
        + 0.2 * F.tanh(c("bullish_volume") - c("bearish_volume"))
        - 0.2 * F.tanh("fear_signal")
        + 0.2 * excess
    )
    s = s.with_columns(sentiment_proxy_smooth=s.mean("sentiment_proxy", 5))
    s = s.with_columns(news_intensity=_intensity())
    names = [f for f in (*FEATURES, "sent_daily_range") if relative or f not in ("excess_return", "relative_strength")]
    filled = {f: F.coalesce(F.nanvl(c(f), F.lit(0.0)), F.lit(0.0)) for f in names}
    return s.with_columns(**filled).drop("_prev", "_v20", "_c5", "_v5", "_r20")


def _intensity():
    """News intensity 0..1 from volume, gap and range; null until the averages are there."""
    c = F.col
    surprise = c("sent_daily_range") / (c("_r20") + 1e-8)
    return clip(
        0.4 * clip(F.abs("volume_surprise"), 0, 5) / 5
        + 0.3 * clip(F.abs("overnight_gap"), 0, 0.1) / 0.1
        + 0.3 * clip(surprise - 1, 0, 3) / 3,
        0,
        1,
    )


def add_proxy(bars: DataFrame, market: DataFrame | None = None, **how) -> DataFrame:
    """Bars with the proxy family; relative features only where a market series is given."""
    if market is not None:
        relative = relative_to_market(bars, market, **how)
        bars = bars.join(relative, ["symbol", "time"], "left")
    return windows(Series.of(bars, behind=BEHIND, **how)).own()


# Fixed value: the first day with news records.
NEWS_START = "2015-02-18"


def sentiment_history(news: DataFrame, bars: DataFrame, *, start: str = NEWS_START, **how) -> DataFrame:
    """Daily sentiment history: news rows from ``start`` on, price-derived rows before, with a source tag.

    ``news``: date, ticker, article_count, avg_tone and any further columns.
    """
    cut = F.lit(start).cast("date")
    old = bars.filter(F.col("time") < cut)
    derived = add_proxy(old, **how).select(
        F.to_date("time").alias("date"),
        F.col("symbol").alias("ticker"),
        F.lit(0).cast("long").alias("article_count"),
        F.lit(0.0).alias("avg_tone"),
        F.col("sentiment_proxy_smooth").alias("sentiment_proxy"),
        "news_intensity",
        F.lit("price_proxy").alias("source"),
    )
    recent = news.filter(F.col("date") >= cut).withColumn("source", F.lit("news"))
    return recent.unionByName(derived, allowMissingColumns=True)
