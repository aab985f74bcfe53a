"""Market context: several series side by side, forward fills, and joins onto bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.positions import sorted_runs
from barloom.functions.series import group_of
from barloom.sources.stage import stage

#: Rows of a key that meet in one task where no calendar unit bounds them.
ROWS = 4096


def market_context(bars: DataFrame, names: Sequence[str], value: str = "close") -> DataFrame:
    """One row per time with ``{name}_{value}`` for every series, forward-filled.

    A pivot replaces the chain of full outer joins: one shuffle for any number of series.
    """
    wide = bars.filter(F.col("symbol").isin(list(names))).groupBy("time").pivot("symbol", list(names))
    table = wide.agg(F.max(value)).withColumnsRenamed({n: f"{n}_{value}" for n in names})
    return forward_fill(table, [f"{n}_{value}" for n in names], key=())


def forward_fill(
    df: DataFrame, names: Sequence[str], *, key: Sequence[str] = ("symbol",), time: str = "time", chunk: str | None = "month"
) -> DataFrame:
    """Carry the last known value of each column forward in time.

    Filled inside calendar chunks first; a chunk whose head is empty takes the last known value of the
    chunks before it, read from one summary row per chunk. No task holds a whole series. A calendar unit suits bars, which
    have one row per key and time; with ``chunk=None`` chunks are cut by number of rows (``ROWS``), for any rows.
    """
    ordered = df.withColumns({"_at": F.col(time), "_o": F.col(time)})
    return _fill_ordered(ordered, names, list(key), chunk).drop("_at", "_o")


def as_of(
    left: DataFrame, right: DataFrame, names: Sequence[str], *, key: Sequence[str] = ("symbol",), chunk: str | None = None
) -> DataFrame:
    """Left rows with the newest right row at or before their time (clocks may differ).

    The values come from one right row, nulls in it included. All left rows stay: a null key meets null keys, a null
    time finds nothing. Rows of a key meet in chunks of ``ROWS`` rows, so a hot key, or a hot moment of it, is many tasks; ``chunk``
    names a calendar unit instead, which saves writing the rows once where it bounds them.
    """
    key = list(key)
    found = right.filter(F.col("time").isNotNull()).select(*key, "time", F.struct(*names).alias("_found"))
    empty = F.lit(None).cast(found.schema["_found"].dataType)
    mark = left.withColumn("_found", empty).withColumn("_left", F.lit(True))
    both = mark.unionByName(found.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    # at equal times the right row must come first; the tie is broken by shifting left rows past it
    both = both.withColumn("_at", F.col("time").cast("timestamp"))
    both = both.withColumn("_o", 2 * F.unix_micros("_at") + F.col("_left").cast("int"))
    out = _fill_ordered(both, ["_found"], key, chunk).filter("_left").drop("_left", "_at", "_o")
    return out.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")


def chunked(df: DataFrame, key: Sequence[str], chunk: str | None) -> tuple[DataFrame, str]:
    """Rows with their chunk in ``_g``, a struct of the key and something that grows with ``_o``; and the order inside it."""
    if chunk is None:
        df, unit, order = sorted_runs(df, key, ["_o"]), F.struct("_run", F.floor(F.col("_place") / ROWS).alias("block")), "_place"
    else:
        unit, order = F.date_trunc(chunk, F.col("_at")), "_o"
    # one struct of key and chunk: it is never null, so no row is lost in the join
    return df.withColumn("_g", F.struct(group_of(key).alias("key"), unit.alias("chunk"))), order


def _fill_ordered(df: DataFrame, names: Sequence[str], key: list[str], chunk: str | None) -> DataFrame:
    kept = df.columns
    df, order = chunked(df, key, chunk)
    if len(names) == 1:
        # the last known value of a chunk may be of any type: cut to one row per task and chunk before the shuffle
        last = Window.partitionBy("_g").orderBy(F.col(names[0]).isNull(), F.desc("_o"))
        ends = df.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1")
        ends = ends.select("_g", F.col(names[0]).alias(f"_{names[0]}_end"))
    else:
        ends = df.groupBy("_g").agg(
            *(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_o"))).alias(f"_{n}_end") for n in names)
        )
    earlier = Window.partitionBy("_g.key").orderBy("_g.chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        "_g", *(F.last(f"_{n}_end", ignorenulls=True).over(earlier).alias(f"_{n}_carry") for n in names)
    )
    inside = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names})
    out = filled.join(carry, "_g")
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_{n}_carry")) for n in names})
    return out.select(*kept)


def join_context(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Bars with the context of their time. The context has one row per time."""
    return bars.join(context, "time", "left")


def join_sentiment(bars: DataFrame, sentiment: DataFrame, keys: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """Bars with sentiment; a missing value in any column named like sentiment is neutral."""
    out = bars.join(sentiment, list(keys), "left")
    return out.na.fill(0.0, subset=[c for c in out.columns if "sentiment" in c.lower()])


def training_features(bars: DataFrame, context: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """Bars, market context and sentiment in one table; context columns carried forward per symbol.

    The joined rows are written, since filling reads them twice.
    """
    names = [c for c in context.columns if c != "time"]
    out = join_context(bars, context)
    if sentiment is not None:
        out = join_sentiment(out, sentiment)
    return forward_fill(stage(out, "joined"), names)
