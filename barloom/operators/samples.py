"""Targets, fixed-length sequences, delisting labels and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import fdiv
from barloom.functions.positions import number_sorted
from barloom.functions.series import Series, number_rows
from barloom.sources.stage import stage


def add_targets(bars: DataFrame, horizons: Sequence[int] = (1, 5, 10), threshold: float = 0.02, **how) -> DataFrame:
    """Forward return, direction (1, 0, -1) and up flag per horizon; an unknown future counts as flat."""
    s = Series.of(bars, behind=0, ahead=max(horizons), **how)
    s = s.with_columns(**{f"target_return_{h}d": fdiv(s.ahead("close", h), F.col("close")) - 1 for h in horizons})
    cells = {}
    for h in horizons:
        r = F.col(f"target_return_{h}d")
        cells[f"target_direction_{h}d"] = F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0)
        cells[f"target_up_{h}d"] = F.when(r > 0, 1).otherwise(0)
    return s.with_columns(**cells).own()


def sequences(df: DataFrame, features: Sequence[str], target: str, length: int = 60, **how) -> DataFrame:
    """Training sequences: the ``length`` complete rows before a row, and the row's target.

    symbol, time (of the target row), x (array of feature arrays, oldest first), y. Sequences never
    cross symbols. Only the named features travel.
    """
    rows = df.select("symbol", "time", F.array(*(F.col(f).cast("double") for f in features)).alias("_f"),
                     F.col(target).alias("y"), *features).na.drop(subset=[*features, "y"])
    s = Series.of(rows.drop(*features), behind=length, **how)
    s = s.with_columns(x=F.collect_list("_f").over(s.w.rowsBetween(-length, -1)))
    return s.own(keep_t=True).filter(F.col("_t") >= length).select("symbol", "time", "x", "y")


def windows(
    df: DataFrame, features: Sequence[str], length: int = 252, horizon: int = 5, extra: Sequence[str] = (), **how
) -> DataFrame:
    """Sliding windows of ``length`` complete rows with the next ``horizon`` returns and up flags.

    The window ends at ``time``. As many windows as ``rows - length - horizon``: the last complete one
    is left out, like the source of the rule does.
    """
    rows = df.select("symbol", "time", "close", *extra, F.array(*(F.col(f).cast("double") for f in features)).alias("_f"),
                     *[f for f in features if f != "close" and f not in extra])
    rows = rows.na.drop(subset=["close", *features])
    s = Series.of(rows.select("symbol", "time", "close", *extra, "_f"), behind=length, ahead=horizon + 1, **how)
    s = s.with_columns(
        x=F.collect_list("_f").over(s.rows(length)),
        _next=F.array(*(s.ahead("close", h) for h in range(1, horizon + 1))),
        _more=s.ahead("close", horizon + 1),
    )
    done = s.own(keep_t=True).filter((F.col("_t") >= length - 1) & F.col("_more").isNotNull())
    done = done.withColumn("target_returns", F.transform("_next", lambda p: fdiv(p, F.col("close")) - 1))
    done = done.withColumn(
        "target_direction", F.transform("target_returns", lambda r: F.when(r > 0, 1.0).otherwise(0.0))
    )
    return done.select("symbol", "time", *extra, "x", "target_returns", "target_direction")


def window_multiplicity(df: DataFrame, length: int, horizon: int, **how) -> DataFrame:
    """Add ``n_windows``: in how many sliding windows of the symbol a row appears."""
    numbered = number_rows(df, **how)
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    t, last = F.col("_t"), F.col("_n") - length - horizon - 1
    n = F.least(t, last) - F.greatest(F.lit(0), t - length + 1) + 1
    return numbered.join(sizes, "symbol").withColumn("n_windows", F.greatest(F.lit(0), n)).drop("_n")


HORIZONS = (30, 90, 180, 365)


def delisting_labels(prices: DataFrame, meta: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Per trading day: days until the symbol's last one, and whether that is within each horizon.

    ``meta`` (symbol, delist_reason, ...) may repeat a symbol; its smallest ``meta_order`` counts, where
    there is such a column.
    """
    order = F.col("meta_order") if "meta_order" in meta.columns else F.col("delist_reason")
    ranked = meta.withColumn("_rank", F.row_number().over(Window.partitionBy("symbol").orderBy(order.asc_nulls_last(), "delist_reason")))
    first = ranked.filter("_rank = 1").select("symbol", "delist_reason")
    last = prices.groupBy("symbol").agg(F.max("time").alias("_last")).join(first, "symbol")
    days = F.timestamp_diff("DAY", F.col("time"), F.col("_last")).cast("int")
    out = prices.join(last, "symbol").withColumn("days_to_delist", days)
    flags = {f"delist_{h}d": F.when(F.col("days_to_delist") <= h, 1).otherwise(0) for h in horizons}
    return out.withColumns(flags).select("symbol", F.col("time").alias("date"), "delist_reason", "days_to_delist", *flags)


def delisted_windows(
    prices: DataFrame, labels: DataFrame | None, features: Sequence[str], n_symbols: int, length: int = 252,
    horizon: int = 5, horizons: Sequence[int] = HORIZONS, **how,
) -> DataFrame:
    """Windows of delisted symbols: out-of-vocabulary index, unknown sector, risk vector (0 if unlabelled)."""
    w = windows(prices, features, length, horizon, **how)
    names = [f"delist_{h}d" for h in horizons]
    if labels is None:
        w = w.withColumn("delist_risk", F.array(*(F.lit(0.0) for _ in names)))
    else:
        keyed = labels.select("symbol", F.col("date").alias("time"), *names)
        w = w.join(keyed, ["symbol", "time"], "left")
        risk = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names))
        w = w.withColumn("delist_risk", risk).drop(*names)
    return w.withColumns(
        {
            "stock_idx": F.lit(n_symbols),
            "sector_id": F.lit(0),
            "industry_id": F.lit(0),
            "is_delisted": F.lit(True),
        }
    )


def with_delisted(live: DataFrame, delisted: DataFrame) -> DataFrame:
    """Live and delisted samples as one table."""
    tagged = live if "is_delisted" in live.columns else live.withColumn("is_delisted", F.lit(False))
    return tagged.unionByName(delisted, allowMissingColumns=True)


def stock_age_months(n_rows: Column) -> Column:
    """Age in months: 21 rows a month, at most 99."""
    return F.least(F.lit(99), F.floor(n_rows / 21)).cast("int")


def symbol_index(df: DataFrame) -> DataFrame:
    """symbol -> dense 0-based index in alphabetical order."""
    numbered = number_sorted(df.select("symbol").distinct(), (), ["symbol"])
    return numbered.select("symbol", F.col("_t").cast("int").alias("stock_idx"))


#: Hex digits of a hash that parts are counted by, and rows that are put in order at once.
DIGITS = 3
FEW = 100_000


def split_symbols(df: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """symbol -> split: seeded pseudo-random order (md5 of seed and symbol), exact 80 / 10 / 10 counts.

    Only the symbols at the two borders are found, not a rank for each: symbols are counted by the first digits of their hash,
    and the parts that hold a border by more digits until few are left.
    """
    seeded = F.md5(F.concat(F.lit(f"{seed}:").cast("binary"), F.coalesce("symbol", F.lit("")).cast("binary")))
    names = stage(df.select("symbol").distinct().withColumn("_h", seeded), "symbols")
    counts = _counts(names, F.substring("_h", 1, DIGITS))
    n = sum(counts.values())
    first = int(n * train)
    borders = [_border(names, counts, k) for k in (first, first + int(n * val))]
    # the null symbol has the hash of the empty one and stands before it
    mine = F.struct("_h", F.coalesce("symbol", F.lit("")).alias("s"), F.col("symbol").isNotNull().alias("k"))

    def before(b):
        return F.lit(True) if b is None else mine < F.struct(F.lit(b[0]).alias("_h"), F.lit(b[1] or "").alias("s"), F.lit(b[1] is not None).alias("k"))

    part = F.when(before(borders[0]), "train").when(before(borders[1]), "val").otherwise("test")
    return names.select("symbol", part.alias("split"))


def _counts(rows: DataFrame, part: Column) -> dict:
    """Rows of every part; parts are few whatever the rows."""
    found = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.part: r.n for r in sorted(found, key=lambda r: r.part)}


def _place(counts: dict, k: int) -> tuple | None:
    """The part that holds row number k, and the row's number in it."""
    for part, n in counts.items():
        if k < n:
            return part, k
        k -= n
    return None


def _border(names: DataFrame, counts: dict, k: int) -> tuple | None:
    """(hash, symbol) of symbol number k in the order of the hashes."""
    digits, found = DIGITS, _place(counts, k)
    while found is not None:
        part, k = found
        names = names.filter(F.substring("_h", 1, digits) == part)
        if counts[part] <= FEW or digits >= 32:
            row = names.orderBy("_h", F.col("symbol").asc_nulls_first()).offset(k).limit(1).first()
            return row._h, row.symbol
        digits += DIGITS
        counts = _counts(names, F.substring("_h", 1, digits))
        found = _place(counts, k)
    return None


def split_time(df: DataFrame, train: float = 0.8) -> DataFrame:
    """Add ``split``: rows before the time at the given share of all distinct times are 'train', without a time 'val'.

    The time is found by counts: of times per day, then per smaller unit of the one that holds it, until few are left.
    """
    times = stage(df.select("time").filter(F.col("time").isNotNull()).distinct(), "times")
    k, cut = None, None
    for unit in ("day", "hour", "minute", "second"):
        part = F.date_trunc(unit, "time")
        counts = _counts(times, part.cast("string"))
        if k is None:
            k = int(sum(counts.values()) * train)
        found = _place(counts, k)
        if found is None:
            break
        name, k = found
        times = times.filter(part.cast("string") == name)
        if counts[name] <= FEW or unit == "second":
            cut = times.orderBy("time").offset(k).limit(1).select(F.col("time").cast("string")).first()[0]
            break
    early = F.lit(True) if cut is None else F.col("time") < F.lit(cut).cast(df.schema["time"].dataType)
    return df.withColumn("split", F.when(F.col("time").isNotNull() & early, "train").otherwise("val"))
