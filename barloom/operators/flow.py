"""Institutional-flow features. Warm-up rows are zero-filled, so 0 means unknown or neutral."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import clip, fdiv, flag, pct
from barloom.functions.series import Series
from barloom.operators.latest import last_n

BEHIND = 200

# The family's columns, in order.
FEATURES = (
    "unusual_volume",
    "block_trade_prob",
    "accumulation_distribution",
    "money_flow_index",
    "smart_money_index",
    "vwap_divergence",
    "obv_trend",
    "pv_divergence",
    "weak_hands_score",
    "squeeze_potential",
    "smart_money_flow",
    "retail_flow",
)


def windows(s: Series, short_interest: str | None = None) -> Series:
    """All fixed look-back features.

    The running lines behind accumulation/distribution, smart money and OBV enter only through
    differences and deviations, so a running total inside the block serves as well as a global one.
    """
    c = F.col
    inside = s.w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.with_columns(
        _prev=s.back("close"),
        _typical=(c("high") + c("low") + c("close")) / 3,
        _range=fdiv(c("high") - c("low"), c("close")),
        _v_mean=s.mean("volume", 20),
        _v_std=s.std("volume", 20),
        _c_std=s.std("close", 20),
        _low20=s.roll(F.min, "low", 20),
        _smi=F.sum(c("close") - c("open")).over(inside),
        _ad=F.sum(
            clip((2 * c("close") - c("low") - c("high")) / (c("high") - c("low") + 1e-8), -1, 1) * c("volume")
        ).over(inside),
        _c10=s.back("close", 10),
        _v10=s.back("volume", 10),
    )
    s = s.long_mean({"_c50": ("close", 50), "_c200": ("close", 200)})
    quiet = c("volume") < c("_v_mean") * 0.7
    busy = c("volume") > c("_v_mean") * 1.5
    s = s.with_columns(
        _ret=pct(c("close"), c("_prev")),
        _t_step=c("_typical") - s.back("_typical"),
        _flow=c("_typical") * c("volume"),
        _sv=F.when(c("close") > c("_prev"), c("volume")).when(c("close") < c("_prev"), -c("volume")).otherwise(0),
        _range20=s.mean("_range", 20),
        _quiet=flag(quiet),
        _busy=flag(busy),
        _ad5=c("_ad") - s.back("_ad", 5),
        _ad_std=s.std("_ad", 20),
        _smi5=c("_smi") - s.back("_smi", 5),
    )
    s = s.with_columns(
        _pos=F.when(c("_t_step") > 0, c("_flow")).otherwise(0.0),
        _neg=F.when(c("_t_step") < 0, c("_flow")).otherwise(0.0),
        _obv=F.sum("_sv").over(inside).cast("double"),
        _vol10=s.std("_ret", 10),
        _quiet5=s.mean("_quiet", 5),
    )
    s = s.with_columns(
        _pos=s.roll(F.sum, "_pos", 14),
        _neg=s.roll(F.sum, "_neg", 14),
        _obv_mean=s.mean("_obv", 20),
        _obv_std=s.std("_obv", 50),
        _vol_mean=s.mean("_vol10", 20),
    )
    near_low = clip(1 - (c("close") - c("_low20")) / (c("_low20") + 1e-8), 0, 1)
    squeeze = 0.4 * near_low + 0.3 * c("_quiet5") + 0.3 * flag((c("_busy") > 0) & (c("close") > c("_prev")))
    if short_interest is not None:
        si = c(short_interest)
        squeeze = F.when(si > 20, clip(squeeze * (1 + si / 100), 0, 1)).otherwise(squeeze)
    s = s.with_columns(
        unusual_volume=1 / (1 + F.exp(-(c("volume") - c("_v_mean")) / (c("_v_std") + 1e-8))),
        block_trade_prob=clip(
            (c("volume") / (c("_v_mean") + 1)) / (c("_range") / (c("_range20") + 1e-8) + 1), 0, 10
        )
        / 10,
        accumulation_distribution=clip(c("_ad5") / (c("_ad_std") + 1e-8), -3, 3) / 3,
        money_flow_index=(100 - 100 / (1 + c("_pos") / (c("_neg") + 1e-8))) / 100,
        smart_money_index=clip(c("_smi5") / (c("_c_std") + 1e-8), -3, 3) / 3,
        obv_trend=clip((c("_obv") - c("_obv_mean")) / (c("_obv_std") + 1e-8), -3, 3) / 3,
        pv_divergence=clip(-pct(c("close"), c("_c10")) * pct(c("volume"), c("_v10")), -0.5, 0.5) * 2,
        weak_hands_score=0.2 * flag(c("close") < c("_c50"))
        + 0.2 * flag(c("close") < c("_c200"))
        + 0.3 * flag(c("close") < c("open")) * c("_busy")
        + 0.2 * flag(c("_vol10") > c("_vol_mean"))
        + 0.1 * flag(c("open") < c("_prev") * 0.98),
        squeeze_potential=squeeze,
    )
    return s.drop(
        "_prev", "_typical", "_range", "_v_mean", "_v_std", "_c_std", "_low20", "_smi", "_ad", "_c10", "_v10",
        "_c50", "_c200", "_ret", "_t_step", "_flow", "_sv", "_range20", "_quiet", "_busy", "_ad5", "_ad_std",
        "_smi5", "_pos", "_neg", "_obv", "_vol10", "_quiet5", "_obv_mean", "_obv_std", "_vol_mean",
    )


def specs() -> dict:
    """Running totals of the never-reset volume-weighted price, for ``Series.accumulate``."""
    c = F.col
    typical = (c("high") + c("low") + c("close")) / 3
    return {"_value": (typical * c("volume"), 1.0), "_volume": (c("volume").cast("double"), 1.0)}


def finish(s: Series) -> Series:
    """Distance to the running volume-weighted price, and the composites. Ends zero-filled."""
    c = F.col
    s = s.with_columns(_vwap=fdiv(c("_value"), c("_volume")))
    s = s.with_columns(vwap_divergence=clip(fdiv(c("close") - c("_vwap"), c("_vwap")), -0.1, 0.1) * 10)
    s = s.with_columns(
        smart_money_flow=0.25
        * (c("accumulation_distribution") + c("smart_money_index") + c("obv_trend") + c("vwap_divergence"))
    )
    s = s.with_columns(retail_flow=-c("smart_money_flow") * c("weak_hands_score"))
    filled = {f: F.coalesce(F.nanvl(c(f), F.lit(0.0)), F.lit(0.0)) for f in FEATURES}
    return s.with_columns(**filled).drop("_value", "_volume", "_vwap")


def add_flow(bars: DataFrame, *, short_interest: str | None = None, **how) -> DataFrame:
    """Bars with the whole flow family. ``short_interest`` names a percent column, if there is one."""
    s = windows(Series.of(bars, behind=BEHIND, **how), short_interest)
    return finish(s.accumulate(specs())).own()


def latest_signals(flow: DataFrame) -> DataFrame:
    """Newest flow summary per symbol, with the interpretation rules applied."""
    newest = last_n(flow, 1, order=("time",)).select("symbol", F.struct("time", *FEATURES).alias("x"))
    out = newest.select(
        "symbol",
        F.col("x.time").alias("time"),
        F.col("x.unusual_volume").alias("unusual_volume_score"),
        F.col("x.block_trade_prob").alias("block_trade_indicator"),
        F.col("x.accumulation_distribution").alias("accumulation_score"),
        (-F.col("x.accumulation_distribution")).alias("distribution_score"),
        F.col("x.smart_money_flow").alias("smart_money_flow"),
        F.col("x.retail_flow").alias("retail_flow"),
        F.col("x.weak_hands_score").alias("weak_hands_score"),
        F.col("x.squeeze_potential").alias("short_squeeze_potential"),
    )
    return out.withColumns(interpretation())


def interpretation() -> dict[str, F.Column]:
    """Reading of the flow scores: the first rule that holds."""
    c = F.col
    smart, weak = c("smart_money_flow"), c("weak_hands_score")
    return {
        "reading": F.when((smart > 0.3) & (weak > 0.5), "accumulating")
        .when((smart < -0.3) & (weak < 0.3), "distributing")
        .when(c("short_squeeze_potential") > 0.6, "squeeze_setup")
        .otherwise("none")
    }


def short_interest_pct(meta: DataFrame) -> DataFrame:
    """Short interest in percent of the float, else of shares outstanding, else null."""
    short = F.coalesce(F.col("shares_short"), F.lit(0))
    return meta.withColumn(
        "short_interest",
        F.when(F.col("float_shares") > 0, short / F.col("float_shares") * 100).when(
            F.col("shares_outstanding") > 0, short / F.col("shares_outstanding") * 100
        ),
    )
