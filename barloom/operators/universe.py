"""Symbol universe: tiers, filters, profiles, dividends and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import ratio

# Lower bounds of the market-cap tiers.
CAP_TIERS = [("mega", 200e9), ("large", 10e9), ("mid", 2e9), ("small", 300e6), ("micro", 50e6)]

# Bounds of the liquidity tiers.
TIERS = {
    "new_listings": {"min_volume": 25_000, "max_days": 500},
    "penny_stocks": {"max_price": 5.0, "min_volume": 50_000, "min_days": 100},
    "blue_chip": {"min_price": 20.0, "min_volume": 500_000, "min_days": 1000},
    "mid_cap": {"min_price": 5.0, "min_volume": 100_000, "min_days": 500},
}

# Bounds of the tradable universe.
UNIVERSE = {"min_market_cap": 1e9, "min_avg_volume": 500_000, "min_price": 5.0, "max_spread_pct": 0.5}
# Fixed value: symbols that are screened at once.
MAX_SIZE = 500


def cap_tier(cap: Column) -> Column:
    """Market-cap tier name."""
    out = F.when(cap.isNull() | (cap <= 0), "unknown")
    for name, low in CAP_TIERS:
        out = out.when(cap >= low, name)
    return out.otherwise("nano")


def cap_bucket(cap: Column) -> Column:
    """Market-cap tier as a code: 0 nano .. 5 mega, -1 unknown."""
    out = F.when(cap.isNull() | (cap <= 0), -1)
    for i, (_, low) in enumerate(CAP_TIERS):
        out = out.when(cap >= low, len(CAP_TIERS) - i)
    return out.otherwise(0)


def profile(bars: DataFrame) -> DataFrame:
    """Mean volume, mean close, last close and number of days per symbol."""
    return bars.groupBy("symbol").agg(
        F.avg("volume").alias("avg_volume"),
        F.avg("close").alias("avg_price"),
        F.max_by("close", "time").alias("current_price"),
        F.count(F.lit(1)).alias("history_days"),
    )


def liquidity_tier(p: DataFrame) -> DataFrame:
    """Add ``tier`` to a profile: the tests run in a fixed order, null if none holds."""
    vol, avg, now, days = (F.col(c) for c in ("avg_volume", "avg_price", "current_price", "history_days"))
    t = TIERS
    tier = (
        F.when((days <= t["new_listings"]["max_days"]) & (vol >= t["new_listings"]["min_volume"]), "new_listings")
        .when(
            (now < t["penny_stocks"]["max_price"])
            & (vol >= t["penny_stocks"]["min_volume"])
            & (days >= t["penny_stocks"]["min_days"]),
            "penny_stocks",
        )
        .when(
            (avg >= t["blue_chip"]["min_price"])
            & (vol >= t["blue_chip"]["min_volume"])
            & (days >= t["blue_chip"]["min_days"]),
            "blue_chip",
        )
        .when(
            (avg >= t["mid_cap"]["min_price"]) & (vol >= t["mid_cap"]["min_volume"]) & (days >= t["mid_cap"]["min_days"]),
            "mid_cap",
        )
    )
    return p.withColumn("tier", tier)


def in_tier(p: DataFrame, tier: str | None = None) -> DataFrame:
    """Rows of one tier, or of any tier."""
    return p.filter(F.col("tier").isNotNull() if tier in (None, "all") else F.col("tier") == tier)


def tradable(u: DataFrame, limits: dict | None = None, max_size: int | None = None) -> DataFrame:
    """The tradable universe: cap, volume, price and spread bounds, one exchange, no depositary receipts.

    All of them, or with ``max_size`` so many by average volume, then symbol (which ones is our choice).
    """
    k = {**UNIVERSE, **(limits or {})}
    good = u.filter(
        (F.col("market_cap") >= k["min_market_cap"])
        & (F.col("avg_volume") >= k["min_avg_volume"])
        & (F.col("price") >= k["min_price"])
        & (F.col("spread_pct") <= k["max_spread_pct"])
        & (F.col("exchange") == "NASDAQ")
        & ~F.col("is_adr")
    )
    return good if max_size is None else good.orderBy(F.desc("avg_volume"), "symbol").limit(max_size)


def active(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def listed_symbols(raw: DataFrame) -> DataFrame:
    """Symbols of a listing file: not null, at most 5 characters, no test issues, no trailer line."""
    s = F.col("Symbol")
    good = s.isNotNull() & (F.length(s) <= 5) & ~F.endswith(s, F.lit("test")) & ~F.startswith(s, F.lit("File Creation"))
    return raw.filter(good).select(s.alias("symbol"))


def plain_symbols(raw: DataFrame) -> DataFrame:
    """Symbols that are letters only, at most 5 of them."""
    return raw.filter(F.col("symbol").rlike(r"^\p{L}+$") & (F.length("symbol") <= 5)).select("symbol")


def dividends(div: DataFrame, prices: DataFrame) -> DataFrame:
    """Trailing-year dividend sum and yield in percent per symbol.

    ``div``: symbol, time, amount; ``prices``: symbol, close. The year ends at the symbol's last dividend.
    """
    last = div.groupBy("symbol").agg(F.max("time").alias("_last"))
    recent = div.join(last, "symbol").filter(F.col("time") > F.col("_last") - F.make_ym_interval(F.lit(1)))
    sums = recent.groupBy("symbol").agg(F.sum("amount").alias("year_sum"))
    out = prices.join(sums, "symbol", "left")
    paid = F.coalesce(F.col("year_sum"), F.lit(0.0))
    return out.select(
        "symbol",
        paid.alias("year_sum"),
        (paid > 0).alias("has_dividend"),
        F.when(F.col("close") > 0, F.round(paid / F.col("close") * 100, 2)).otherwise(0.0).alias("dividend_yield"),
    )


def top_payers(d: DataFrame, k: int = 10) -> DataFrame:
    return d.orderBy(F.desc("dividend_yield"), "symbol").limit(k)


def longest_histories(spans: DataFrame, k: int = 10, min_rows: int = 1000) -> DataFrame:
    return spans.filter(F.col("n_rows") > min_rows).orderBy(F.desc("n_rows"), "symbol").limit(k)


def tier_counts(p: DataFrame) -> DataFrame:
    """Symbols and dividend payers per tier."""
    return p.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("has_dividend").cast("long")).alias("dividend_payers")
    )


def summary(meta: DataFrame) -> DataFrame:
    """Counts per sector and cap tier with sector and grand totals, mean and maximum years (days / 252)."""
    years = F.col("total_trading_days") / 252
    return meta.rollup("sector", "market_cap_tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg(years).alias("mean_years"), F.max(years).alias("max_years")
    )


def tier_symbols(p: DataFrame) -> DataFrame:
    """tier, symbol: the rows of the per-tier symbol lists. Kept as rows, so a large tier stays spread out."""
    return in_tier(p).select("tier", "symbol")


def spread_pct(bid: Column, ask: Column) -> Column:
    return ratio(ask - bid, (ask + bid) / 2) * 100
