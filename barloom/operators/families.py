"""All feature families on one frame, column lists, and shaping of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import finite
from barloom.functions.series import Series
from barloom.operators import flow, proxy, technical
from barloom.sources.stage import stage

PRICE = technical.FEATURES
SENTIMENT = proxy.FEATURES
INSTITUTIONAL = flow.FEATURES
MARKET = ("volatility_20", "volume_ratio")

# The widths the feature vectors are padded to.
WIDTHS = {"price": 32, "sentiment": 20, "institutional": 12, "market": 16}
FAMILIES = {"price": PRICE, "sentiment": SENTIMENT, "institutional": INSTITUTIONAL, "market": MARKET}


def add_all(bars: DataFrame, market: DataFrame | None = None, **how) -> DataFrame:
    """Technical, sentiment and flow families in one pass over the blocks, with a single carry.

    With a market series its relative columns are matched first, and the matched rows written: the blocks and their carry read
    them twice.
    """
    if market is not None:
        relative = proxy.relative_to_market(bars, market, **how)
        bars = stage(bars.join(relative, ["symbol", "time"], "left"), "matched")
    s = Series.of(bars, behind=technical.BEHIND, **how)
    s = flow.windows(proxy.windows(technical.windows(s)))
    s = s.accumulate({**technical.specs(), **flow.specs()})
    return flow.finish(technical.finish(s)).own()


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names the frame really has, in order; missing ones are skipped."""
    return [n for n in names if n in df.columns]


def missing_columns(df: DataFrame, required: Sequence[str] = ("open", "high", "low", "close", "volume")) -> list[str]:
    """Required columns the frame lacks."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c not in have]


def status_rows(df: DataFrame, required: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """One row per symbol: status ok, or error with the columns that the frame lacks as the reason."""
    lacking = missing_columns(df, required)
    reason = F.lit(f"missing columns: {', '.join(lacking)}" if lacking else None).cast("string")
    status = F.lit("error" if lacking else "ok")
    return df.select("symbol").distinct().select("symbol", status.alias("status"), reason.alias("reason"))


def padded(columns: Sequence[str], width: int) -> Column:
    """The columns as an array of exactly ``width`` doubles, zeros appended. More columns than that are an error."""
    if len(columns) > width:
        raise ValueError(f"{len(columns)} columns do not fit into {width} places")
    cols = [F.col(c).cast("double") for c in columns]
    return F.concat(F.array(*cols), F.array_repeat(F.lit(0.0), width - len(cols)))


def vectors(df: DataFrame) -> DataFrame:
    """One padded, finite array per family."""
    cells = {}
    for family, names in FAMILIES.items():
        clean = F.transform(padded(present(df, names), WIDTHS[family]), lambda x: finite(x))
        cells[f"{family}_features"] = clean
    return df.withColumns(cells)


def drop_incomplete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows where all the names are set."""
    return df.na.drop(subset=present(df, names))


def zero_filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Nulls of the named columns replaced by 0."""
    return df.na.fill(0.0, subset=present(df, names))
