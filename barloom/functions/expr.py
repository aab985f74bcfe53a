"""Column helpers shared by the operator modules.

Spark runs in ANSI mode, so a zero divisor raises; ``ratio`` and ``fdiv`` spell out what the
market formulas expect instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either side is null."""
    return F.when(b != 0, a / b)


def fdiv(a: Column, b: Column) -> Column:
    """a / b with floating-point rules: x/0 is a signed infinity, 0/0 is null."""
    return (
        F.when(b != 0, a / b)
        .when((b == 0) & (a > 0), F.lit(INF))
        .when((b == 0) & (a < 0), F.lit(-INF))
    )


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound x to [lo, hi]; null and NaN give null (least/greatest alone would skip or saturate)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, else 0.0; an unknown condition counts as 0.0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def pct(now: Column, before: Column) -> Column:
    """Relative change now / before - 1."""
    return fdiv(now, before) - 1


def finite(x: Column, pos: float = 3.0, neg: float = -3.0, missing: float = 0.0) -> Column:
    """Replace null/NaN and infinities by fixed numbers."""
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(float(missing)))
        .when(x == INF, F.lit(float(pos)))
        .when(x == -INF, F.lit(float(neg)))
        .otherwise(x)
    )
