"""Articles: identity, dedupe, upsert, daily and decayed sentiment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import clip, ratio
from barloom.functions.series import Series

# Credibility of a source; any other counts as unknown.
SOURCE_WEIGHTS = {
    "reuters": 1.0,
    "bloomberg": 1.0,
    "wsj": 0.95,
    "cnbc": 0.85,
    "benzinga": 0.80,
    "seekingalpha": 0.70,
    "motleyfool": 0.60,
    "unknown": 0.50,
}

# The order in which sources win when they carry the same article.
SOURCE_ORDER = ("google_news", "yahoo_finance", "finviz", "reddit")


#: Stands for a missing title or address in the hash, which an empty one does not.
MISSING = "\x01"


def article_hash(title: Column, url: Column) -> Column:
    """First 16 hex digits of md5(title, url). An article without either has no hash: it equals no other."""
    both = F.concat(F.coalesce(title, F.lit(MISSING)), F.coalesce(url, F.lit(MISSING)))
    return F.when(title.isNotNull() | url.isNotNull(), F.substring(F.md5(both), 1, 16))


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", article_hash(F.col("title"), F.col("url")))


def fan_in(*sources: DataFrame) -> DataFrame:
    """Landed articles of several sources as one table with the source's rank (first source wins)."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(rank))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in an explicit order. Each task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row per value of one column, which comes first."""
    return first_of(df, [key], order).select(key, *(c for c in df.columns if c != key))


def dedupe_articles(df: DataFrame, order: Sequence[str] = ("source_rank", "article_id")) -> DataFrame:
    """One row per article hash; the first in source order stays. Articles without a hash stay, one per place in the order."""
    df = df if "hash" in df.columns else with_hash(df)
    same = F.coalesce("hash", F.concat(F.lit("?"), F.to_json(F.struct(*order))))
    return first_per(df.withColumn("_same", same), "_same", order).select("hash", *(c for c in df.columns if c != "hash"))


def new_only(df: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    """Articles whose hash is not stored yet; those without a hash are always new."""
    return df.join(seen.select(key), key, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert or replace: rows of ``delta`` win over rows of ``base`` with the same keys.

    Of rows of ``delta`` with the same keys the last in ``order`` wins; without an order its keys must be unique.
    Null is a value of a key like any other, unless all keys are null: such rows have no identity and are added.
    """
    known = reduce(or_, (F.col(k).isNotNull() for k in keys))
    if order:
        some = first_of(delta.filter(known), keys, [F.desc(c) for c in order])
        delta = some.unionByName(delta.filter(~known))
    named = delta.filter(known).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    kept = base.join(named, same, "left_anti")
    return kept.unionByName(delta.select(*(c for c in delta.columns if c not in order or c in base.columns)), allowMissingColumns=True)


def in_range(df: DataFrame, symbol: str, start: str | None = None, end: str | None = None, time: str = "published") -> DataFrame:
    """Articles of a symbol between two times, newest first, then by id where there is one."""
    out = df.filter(F.col("symbol") == symbol)
    kind = df.schema[time].dataType
    if start is not None:
        out = out.filter(F.col(time) >= F.lit(start).cast(kind))
    if end is not None:
        out = out.filter(F.col(time) <= F.lit(end).cast(kind))
    ties = [c for c in ("article_id", "hash", "url") if c in out.columns]
    return out.orderBy(F.desc(time), *ties)


def daily_range(df: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Daily sentiment of a symbol in a date range, oldest first."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.filter((F.col("symbol") == symbol) & inside).orderBy("date")


def daily_sentiment(df: DataFrame) -> DataFrame:
    """Mean, population deviation (0 for one article) and count of scored articles per symbol and day,
    with the mean per source as a map.

    Aggregated per source first, so only one row per (symbol, day, source) is collected into the map.
    """
    scored = df.filter(F.col("sentiment").isNotNull()).withColumn("date", F.to_date("published"))
    s = F.col("sentiment")
    per = scored.groupBy("symbol", "date", "source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("m"), F.coalesce(F.var_pop(s), F.lit(0.0)).alias("v")
    )
    n = F.sum("n")
    mean = F.sum(F.col("m") * F.col("n")) / n
    # within-source plus between-source variance
    square = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n
    return per.groupBy("symbol", "date").agg(
        mean.alias("avg_sentiment"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))).otherwise(0.0).alias("sentiment_std"),
        n.alias("article_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "m")))).alias("source_breakdown"),
    )


def ticker_sentiment(df: DataFrame, score: str = "tone", scale: float = 1.0) -> DataFrame:
    """Per day and ticker: count, tone mean and sample deviation, score mean and deviation, and the share of
    bullish (> 0.1) and bearish (< -0.1) scores after dividing by ``scale``."""
    s = F.col(score) / scale
    return df.groupBy("date", "ticker").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.avg("tone").alias("avg_tone"),
        F.stddev_samp("tone").alias("tone_std"),
        F.avg(score).alias("avg_score"),
        F.stddev_samp(score).alias("score_std"),
        F.avg((s > 0.1).cast("double")).alias("bullish_ratio"),
        F.avg((s < -0.1).cast("double")).alias("bearish_ratio"),
    )


def ticker_totals(daily: DataFrame) -> DataFrame:
    """Daily sentiment rolled up per ticker."""
    return daily.groupBy("ticker").agg(F.sum("article_count").alias("article_count"), F.avg("avg_tone").alias("avg_tone"))


def source_weight(source: Column, weights: dict[str, float] = SOURCE_WEIGHTS) -> Column:
    out = None
    for name, w in weights.items():
        cond = F.lower(source) == name
        out = F.when(cond, w) if out is None else out.when(cond, w)
    return out.otherwise(weights["unknown"])


def decayed_sentiment(
    df: DataFrame, *, step_hours: int = 24, lookback_hours: int = 24, decay_hours: float = 6.0, trail: int = 20,
    weights: dict[str, float] = SOURCE_WEIGHTS, **how,
) -> DataFrame:
    """Time-decayed, credibility-weighted sentiment at the points of a regular time grid.

    An article counts at every grid point that is at most ``lookback_hours`` younger; it is copied to
    those (one copy on a daily grid) and everything is one aggregate, with partial sums before the
    shuffle. The decay is exp(-age / decay_hours), as the rule is written. Attention (count against its
    trailing mean and deviation), momentum (change since the previous point) and the headline with the
    largest weighted score are our definitions.
    """
    step = step_hours * 3600
    at = F.unix_micros(F.col("published").cast("timestamp")) / 1e6
    first = F.ceil(at / step)
    last = F.ceil((at + lookback_hours * 3600) / step) - 1
    copies = (
        df.filter(F.col("sentiment").isNotNull())
        .withColumn("_at", at)
        .withColumn("_k", F.explode(F.when(last >= first, F.sequence(first, last))))
        .withColumn("_age", F.col("_k") * step - F.col("_at"))
    )
    w = F.exp(-F.col("_age") / (decay_hours * 3600)) * source_weight(F.col("source"), weights) * F.col("confidence")
    copies = copies.withColumn("_w", w).withColumn("_sw", F.col("sentiment") * F.col("_w"))
    grid = copies.groupBy("symbol", F.timestamp_seconds(F.col("_k") * step).cast("timestamp_ntz").alias("time")).agg(
        ratio(F.sum("_sw"), F.sum("_w")).alias("weighted_sentiment"),
        F.count(F.lit(1)).alias("article_count"),
        F.max_by("title", F.struct(F.abs("_sw"), -F.col("article_id"))).alias("top_headline"),
    )
    s = Series.of(grid, behind=trail, staged=True, **how)
    s = s.with_columns(
        _before=s.back("weighted_sentiment"),
        _mean=s.mean("article_count", trail),
        _std=s.std("article_count", trail),
    )
    return (
        s.with_columns(
            sentiment_momentum=F.col("weighted_sentiment") - F.col("_before"),
            attention_score=(F.col("article_count") - F.col("_mean")) / (F.col("_std") + 1e-8),
        )
        .drop("_before", "_mean", "_std")
        .own()
    )


def parse_reply(reply: Column) -> dict[str, Column]:
    """Score, confidence and reason from a model's free-form reply: the first {...} block as JSON.

    No block or broken JSON gives nulls; a missing score is 0, a missing confidence 0.5; both are clamped.
    """
    block = F.regexp_extract(reply, r"(?s)(\{[^}]+\})", 1)
    x = F.from_json(block, "sentiment_score double, confidence double, reasoning string, _bad string",
                    {"columnNameOfCorruptRecord": "_bad"})
    ok = (block != "") & x["_bad"].isNull()
    score = F.coalesce(x["sentiment_score"], F.lit(0.0))
    sure = F.coalesce(x["confidence"], F.lit(0.5))
    return {
        "sentiment": F.when(ok, clip(score, -1, 1)),
        "confidence": F.when(ok, clip(sure, 0, 1)),
        "reasoning": F.when(ok, F.coalesce(x["reasoning"], F.lit(""))),
    }


def fallback_score(score: Column, confidence: Column, tone: Column) -> dict[str, Column]:
    """Model score where there is one, else tone / 100 with confidence 0.3."""
    return {
        "score": F.coalesce(score, tone / 100),
        "score_confidence": F.when(score.isNull(), 0.3).otherwise(confidence),
    }


def from_probabilities(bear: Column, neutral: Column, bull: Column) -> dict[str, Column]:
    """Score p(bull) - p(bear), confidence the largest probability, and its label."""
    top = F.greatest(bear, neutral, bull)
    return {
        "score": bull - bear,
        "confidence": top,
        "label": F.when(bull == top, "bullish").when(bear == top, "bearish").otherwise("neutral"),
    }
