"""Prediction, loss and portfolio metrics as plain aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.functions.series import Series, number_rows
from barloom.sources.stage import stage


def correlation(y: str, p: str) -> Column:
    """Pearson correlation; null where a side has no spread (the built-in raises in ANSI mode)."""
    return ratio(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """MSE, RMSE, MAE, correlation and share of equal signs."""
    err = F.col(y) - F.col(p)
    mse = F.avg(err * err)
    return df.groupBy(*by).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        correlation(y, p).alias("correlation"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("direction_accuracy"),
    )


def horizon_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per forecast day of array columns: correlation (0 if undefined) and share of equal up flags."""
    days = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("i", "c"))
    pair = days.select((F.col("i") + 1).alias("day"), F.col("c.y").alias("y"), F.col("c.p").alias("p"))
    r = correlation("y", "p")
    return pair.groupBy("day").agg(
        F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("correlation"),
        F.avg(((F.col("y") > 0) == (F.col("p") > 0)).cast("double")).alias("direction_accuracy"),
    )


def bce(p: Column, y: Column) -> Column:
    """Binary cross-entropy of a probability; logarithms are bounded at -100."""
    log = lambda x: F.when(x <= 0, -100.0).otherwise(F.greatest(F.lit(-100.0), F.ln(x)))
    return -(y * log(p) + (1 - y) * log(1 - p))


def bce_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the overflow-free form."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def gaussian_nll(mu: Column, sigma: Column, y: Column) -> Column:
    return F.ln(sigma + 1e-8) + F.pow(mu - y, 2) / (2 * F.pow(sigma, 2) + 1e-8)


# Weight of each loss part in the total, and of a delisted row in the delisting part.
LOSS_WEIGHTS = {"price_mse": 1.0, "direction_bce": 0.5, "uncertainty_nll": 0.2, "delist_bce": 0.5}
DELISTED_WEIGHT = 5.0


def loss_metrics(df: DataFrame) -> DataFrame:
    """Loss parts and their weighted total over (y, mu, sigma, delist_p, delist_y, is_delisted).

    Columns hold one value per row, or arrays (one value per forecast day, one per delisting horizon);
    every element counts alike.
    """
    c = F.col
    arrays = dict(df.dtypes)["y"].startswith("array")
    up = lambda y: F.when(y > 0, 1.0).otherwise(0.0)
    weight = F.when(c("is_delisted"), DELISTED_WEIGHT).otherwise(1.0)

    def mean(fn, *names) -> Column:
        if not arrays:
            return fn(*(c(n) for n in names))
        zipped = F.arrays_zip(*(c(n).alias(n) for n in names))
        total = F.aggregate(zipped, F.lit(0.0), lambda acc, e: acc + fn(*(e[n] for n in names)))
        return total / F.size(zipped)

    parts = df.agg(
        F.avg(mean(lambda mu, y: F.pow(mu - y, 2), "mu", "y")).alias("price_mse"),
        F.avg(mean(lambda mu, y: bce_logits(mu, up(y)), "mu", "y")).alias("direction_bce"),
        F.avg(mean(gaussian_nll, "mu", "sigma", "y")).alias("uncertainty_nll"),
        F.avg(weight * mean(bce, "delist_p", "delist_y")).alias("delist_bce"),
    )
    total = sum((F.col(n) * w for n, w in LOSS_WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("total_loss", total)


def portfolio_metrics(returns: DataFrame, *, key: tuple[str, ...] = ("symbol",), **how) -> DataFrame:
    """Total return, Sharpe ratio, maximum drawdown, win rate, profit factor from periodic returns ``r``.

    Standard definitions. The drawdown needs the wealth line: log returns accumulate over blocks, and
    the running peak is the larger of the peak inside a block and that of the blocks before it.
    """
    rows = returns.filter(F.col("r").isNotNull()).withColumn("_l", F.log1p("r"))
    # the wealth line and its peak each read their input twice: number once, keep that
    numbered = stage(number_rows(rows, key=key, staged=True, **how), "returns")
    s = Series.of(numbered, behind=0, key=key).accumulate({"_wealth": (F.col("_l"), 1.0)})
    s = s.running_max("_peak", "_wealth")
    # the line starts from 1, so the peak is never below log 1 = 0
    fall = 1 - F.exp(F.col("_wealth") - F.greatest(F.col("_peak"), F.lit(0.0)))
    draw = s.own().groupBy(*key).agg(F.max(fall).alias("max_drawdown"))
    base = numbered.groupBy(*key).agg(
        (F.exp(F.sum("_l")) - 1).alias("total_return"),
        (ratio(F.avg("r"), F.stddev_samp("r")) * math.sqrt(252)).alias("sharpe_ratio"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
        ratio(F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))).alias(
            "profit_factor"
        ),
    )
    return base.join(draw, list(key))


def trade_metrics(trades: DataFrame, *, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Average duration in days, win rate and profit factor of closed trades (opened_at, closed_at, pnl)."""
    seconds = F.timestamp_diff("SECOND", F.col("opened_at"), F.col("closed_at"))
    return trades.groupBy(*key).agg(
        (F.avg(seconds) / 86400).alias("avg_trade_duration"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        ratio(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))).alias(
            "profit_factor"
        ),
    )
