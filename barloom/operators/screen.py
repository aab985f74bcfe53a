"""Cross-sectional screening: z-scores per time, composite score, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series

# Weight of each factor group in the composite score.
GROUP_WEIGHTS = {"momentum": 0.40, "volume": 0.20, "volatility": 0.15, "sentiment": 0.25}

# Factors of each group (equal weights inside a group are our choice).
GROUPS = {
    "momentum": ("momentum_5", "momentum_20", "rsi_14", "macd_histogram"),
    "volume": ("volume_ratio", "accumulation_distribution", "obv_trend"),
    "volatility": ("atr_percentile", "bb_position"),
    "sentiment": ("news_sentiment", "news_volume"),
}

TOP_N = 20


def zscores(df: DataFrame, factors: Sequence[str], at: str = "time") -> DataFrame:
    """Add ``z_{factor}``: distance from the mean of all symbols at that time, in deviations (0 if there is none).

    Means and deviations are pre-aggregated per time and joined back, so no task holds a whole time.
    """
    cells = []
    for f in factors:
        cells += [F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}")]
    stats = df.groupBy(at).agg(*cells)
    out = df.join(stats, at)
    z = {
        f"z_{f}": F.when(F.col(f"_s_{f}") > 0, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(
            F.when(F.col(f).isNotNull(), 0.0)
        )
        for f in factors
    }
    return out.withColumns(z).drop(*(f"_{k}_{f}" for f in factors for k in "ms"))


def composite(df: DataFrame, groups: dict[str, Sequence[str]] = GROUPS, weights: dict[str, float] = GROUP_WEIGHTS) -> DataFrame:
    """Group scores (mean of the z-scores that are there) and their weighted sum."""
    scores = {}
    for g, names in groups.items():
        z = [F.col(f"z_{n}") for n in names if f"z_{n}" in df.columns]
        known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in z), F.lit(0))
        total = sum((F.coalesce(c, F.lit(0.0)) for c in z), F.lit(0.0))
        scores[f"{g}_score"] = F.when(known > 0, total / known).otherwise(0.0)
    out = df.withColumns(scores)
    mix = sum((F.col(f"{g}_score") * w for g, w in weights.items()), F.lit(0.0))
    return out.withColumn("composite_score", mix)


def rank(df: DataFrame, n: int | None = TOP_N, at: str = "time", score: str = "composite_score") -> DataFrame:
    """Rank per time by falling score, ties by symbol; the first n. Spark cuts to n before the shuffle."""
    w = Window.partitionBy(at).orderBy(F.desc(score), "symbol")
    out = df.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.filter(F.col("rank") <= n)


def trailing_percentile(df: DataFrame, c: str, out: str, n: int = 252, **how) -> DataFrame:
    """Share of the other values in the trailing n rows that lie below the current one."""
    s = Series.of(df, behind=n, **how)
    s = s.with_columns(_vals=F.collect_list(c).over(s.rows(n)))
    below = F.size(F.filter("_vals", lambda v: v < F.col(c)))
    share = F.when(F.size("_vals") > 1, below / (F.size("_vals") - 1))
    return s.with_columns(**{out: F.when(F.col(c).isNotNull(), share)}).drop("_vals").own()


def screen(df: DataFrame, n: int = TOP_N, groups: dict[str, Sequence[str]] = GROUPS) -> DataFrame:
    """Z-scores of every factor present, composite score and the top n of each time."""
    names = [f for names in groups.values() for f in names if f in df.columns]
    return rank(composite(zscores(df, names), groups), n)
