"""Named queries over the test tables, each with an independent SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a query. DOUBLE results are rounded on both sides before they are compared."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        run.plain = fn
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return add


# Added before rounding, so that a value exactly between two roundings (frequent with cents divided by
# 16 or 32) is not decided by the order in which an engine added things up.
NUDGE = 1.3e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return df.select(
        *(
            (F.round(F.col(f"`{c}`") + NUDGE, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        )
    )


def final(body: str, doubles: str, digits: int = 6, columns: str | None = None) -> str:
    """SQL: the last SELECT over ``body``, rounding the named double columns."""
    swap = ", ".join(f"round({c} + {NUDGE}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
    star = f"* REPLACE ({swap})" if swap else "*"
    inner = f"(SELECT {columns} FROM {body})" if columns else body
    return f"SELECT {star} FROM {inner}"
