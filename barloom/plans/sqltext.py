"""Small builders for the comparison SQL."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY time"


def over(expr: str, n: int | None = None) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"{expr} OVER ({W}{frame})"


def roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN {over(f'count({x})', n)} = {n} THEN {over(f'{fn}({x})', n)} END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) = 0 AND ({b}) = 0 THEN NULL ELSE ({a})::DOUBLE / ({b}) END"


def lag(x: str, n: int = 1) -> str:
    return over(f"lag({x}, {n})")


def chg(x: str, n: int = 1) -> str:
    return f"(({div(x, lag(x, n))}) - 1)"


def clip(x: str, lo, hi) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) THEN NULL WHEN ({x}) < {lo} THEN {lo}::DOUBLE WHEN ({x}) > {hi} THEN {hi}::DOUBLE ELSE ({x}) END"


def b(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)::DOUBLE"


def cum(x: str) -> str:
    return f"sum({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def ewm(x: str, alpha: str, start: int = 0) -> str:
    """Recursive average in closed form over the position t (a column of the input)."""
    d = f"(1 - {alpha})"
    term = f"(CASE WHEN t < {start} THEN 0 WHEN t = {start} THEN {x} ELSE {alpha} * {x} END) * pow({d}, -t)"
    return f"pow({d}, t) * {cum(term)}"


def span(x: str, n: int) -> str:
    return ewm(x, f"(2.0::DOUBLE / {n + 1})")
