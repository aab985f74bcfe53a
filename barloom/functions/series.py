"""Row-ordered windows that do not depend on how many rows one key has.

``Window.partitionBy(symbol)`` sends every row of a symbol to one task, which breaks once a symbol
holds a large part of the table. Every trailing window in this package therefore runs on *blocks*:

1. ``number_rows`` gives each row its 0-based position ``_t`` within its key. Rows are ranked inside
   (key, calendar chunk); chunk sizes, pre-aggregated before the shuffle, are turned into running
   offsets and joined back. The largest group is one key within one chunk.
2. ``Series.of`` sends row ``_t`` to block ``_t div size`` and, when a window reaches over a block
   border, also to the neighbouring blocks that look at it. Windows run on (key, block), so the
   largest group is ``size + behind + ahead`` rows, whatever the skew.
   A stored layer that already has ``_t`` skips step 1.
3. Running totals and recursive averages (``accumulate``) are computed inside each block and
   completed with a carry from the preceding blocks, read from one summary row per block.

All expressions of a family share one window specification, so Spark plans one exchange and one sort.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.stage import stage

SIZE = 1024


def number_rows(
    df: DataFrame,
    *,
    key: Sequence[str] = ("symbol",),
    time: str = "time",
    order: Sequence[str] | None = None,
    chunk: str | Column = "month",
    staged: bool = False,
) -> DataFrame:
    """Add ``_t``, the 0-based position of a row within its key in the given order.

    ``order`` must start with ``time`` and leave no ties (bars have one row per symbol and time; other rows
    name a sequence column too), or a repeated task may rank rows differently. Rows are ranked inside chunks: a calendar unit of ``time``, or
    any column that grows with the order. With an empty key the whole table is numbered.

    Counting and ranking both read ``df``. Where it is costly (joined, aggregated), ``staged`` writes it
    to the shared folder first, so that it is computed once. A stored table that has ``_t`` (all rows of
    its keys) is left as it is: numbering is part of building a bar layer, not of every query.
    """
    if "_t" in df.columns:
        return df
    if staged:
        df = stage(df, "rows")
    order = list(order or [time])
    key = list(key)
    # grouped by one struct: it is never null, so rows with a null key or time keep their place (nulls first)
    unit = F.date_trunc(chunk, F.col(time)) if isinstance(chunk, str) else chunk
    df = df.withColumn("_g", F.struct(group_of(key).alias("key"), unit.alias("chunk")))
    sizes = df.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g.key").orderBy("_g.chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_g").orderBy(*order)
    return (
        df.withColumn("_i", F.row_number().over(inside))
        .join(starts, "_g")
        .withColumn("_t", (F.col("_start") + F.col("_i") - 1).cast("long"))
        .drop("_g", "_i", "_start")
    )


def group_of(key: Sequence[str]) -> Column:
    """The key columns as one struct, which is not null where they are."""
    return F.struct(*(F.col(k) for k in key)) if key else F.struct(F.lit(0).alias("all"))


class Series:
    """Keyed, ordered rows cut into overlapping blocks."""

    def __init__(self, df: DataFrame, key: Sequence[str], size: int, numbered: bool = False):
        self.df = df
        self.key = list(key)
        self.size = size
        self.numbered = numbered
        self.w = Window.partitionBy("_key", "_blk").orderBy("_t")

    @classmethod
    def of(
        cls,
        df: DataFrame,
        *,
        behind: int,
        ahead: int = 0,
        key: Sequence[str] = ("symbol",),
        time: str = "time",
        order: Sequence[str] | None = None,
        chunk: str = "month",
        size: int | None = None,
        staged: bool = False,
    ) -> "Series":
        """Cut ``df`` into blocks whose windows may look ``behind`` / ``ahead`` rows past the border.

        A frame that already carries ``_t`` (a stored, numbered table) is not numbered again, and the
        result carries it on.
        """
        size = size or SIZE
        numbered = "_t" in df.columns
        df = number_rows(df, key=key, time=time, order=order, chunk=chunk, staged=staged)
        home = F.floor(F.col("_t") / size)
        first = F.greatest(F.lit(0), F.floor((F.col("_t") - ahead) / size))
        last = F.floor((F.col("_t") + behind) / size)
        cut = df.withColumn("_home", home).withColumn("_blk", F.explode(F.sequence(first, last)))
        cut = cut.withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home").withColumn("_key", group_of(key))
        return cls(cut, key, size, numbered)

    def _with(self, df: DataFrame) -> "Series":
        out = copy.copy(self)
        out.df = df
        return out

    def with_columns(self, **cols: Column) -> "Series":
        return self._with(self.df.withColumns(cols))

    def drop(self, *cols: str) -> "Series":
        return self._with(self.df.drop(*cols))

    def own(self, keep_t: bool | None = None) -> DataFrame:
        """Each input row once, with everything computed on it; ``_t`` stays if the input had it."""
        out = self.df.filter("_own").drop("_blk", "_own", "_key")
        return out if (self.numbered if keep_t is None else keep_t) else out.drop("_t")

    # -- window expressions --------------------------------------------------------------------

    def back(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def ahead(self, c: str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)

    def rows(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def roll(self, agg, c: str, n: int) -> Column:
        """agg over the last n rows; null until n values are there."""
        frame = self.rows(n)
        return F.when(F.count(c).over(frame) == n, agg(F.col(c)).over(frame))

    def mean(self, c: str, n: int) -> Column:
        # sum / n: an average would keep a second count beside the one that checks the window
        return self.roll(lambda x: F.sum(x.cast("double")), c, n) / n

    def long_mean(self, names: dict[str, tuple[str, int]]) -> "Series":
        """Trailing means over long windows, as sums of lagged partial sums.

        ``names`` maps an output column to (input column, rows). A partial sum is null until its own
        rows are there, so the total is null until all are.
        """
        parts: dict[str, Column] = {}
        outs: dict[str, Column] = {}
        for out, (c, n) in names.items():
            part = max(a for a in range(1, 2 * math.isqrt(n)) if n % a == 0)
            tmp = f"_sum_{c}_{part}"
            parts[tmp] = self.roll(F.sum, c, part)
            total = F.col(tmp)
            for k in range(1, n // part):
                total = total + self.back(tmp, k * part)
            outs[out] = total / n
        return self.with_columns(**parts).with_columns(**outs).drop(*parts)

    def std(self, c: str, n: int) -> Column:
        return self.roll(F.stddev_samp, c, n)

    # -- running totals and recursive averages -------------------------------------------------

    def accumulate(self, specs: dict[str, tuple[Column, float]]) -> "Series":
        """Add ``name_t = decay * name_{t-1} + term_t`` for every name -> (term, decay).

        decay 1 gives a running total, below 1 a recursive average. Inside a block the recursion is
        one cumulative window; the carry is what the preceding blocks contribute: a running total
        of block sums for decay 1 (``scan_blocks``), else the few last blocks that still weigh more than 1e-16 (``_carried``).
        Results are defined on own rows only. Positions may be missing (a filtered stored layer): a block's
        contribution is read at its last own row, and blocks without rows are passed over.
        """
        pos = F.col("_t") - F.col("_blk") * self.size
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        local: dict[str, Column] = {}
        for name, (term, decay) in specs.items():
            if decay < 1 and -math.log(decay) * self.size > 700:
                raise ValueError(f"block size {self.size} overflows at decay {decay}")
            weighted = term if decay == 1 else term * F.pow(F.lit(decay), -pos)
            total = F.sum(F.when(F.col("_own"), weighted)).over(upto)
            local[f"_{name}_in"] = total if decay == 1 else total * F.pow(F.lit(decay), pos)
        frame = self.df.withColumns(local)
        own = frame.filter("_own").groupBy("_key", "_blk")
        ends = own.agg(F.max("_t").alias("_end"), *(F.max_by(n, "_t").alias(n) for n in local))
        decaying = {n: decay for n, (_, decay) in specs.items() if decay < 1}
        carry = _carried(ends, decaying, self.size) if decaying else None
        totals = [f"_{n}_in" for n in specs if n not in decaying]
        if totals:
            sums = scan_blocks(ends, {n: n.removesuffix("_in") + "_carry" for n in totals}, F.sum)
            carry = sums if carry is None else carry.join(sums, ["_key", "_blk"], "full")
        joined = frame.join(carry, ["_key", "_blk"], "left")
        outs = {}
        for name, (_, decay) in specs.items():
            brought = F.coalesce(F.col(f"_{name}_carry"), F.lit(0.0))
            if decay < 1:
                brought = brought * F.pow(F.lit(decay), pos + 1)
            outs[name] = F.coalesce(F.col(f"_{name}_in"), F.lit(0.0)) + brought
        drop = [*local, *(f"_{n}_carry" for n in specs)]
        return self._with(joined.withColumns(outs).drop(*drop))

    def running_max(self, name: str, c: str) -> "Series":
        """Add the largest value of ``c`` so far: inside the block, and over the blocks before it."""
        frame = self.df.withColumn("_v", F.when(F.col("_own"), F.col(c)))
        tops = frame.filter("_own").groupBy("_key", "_blk").agg(F.max("_v").alias("_top"))
        before = scan_blocks(tops, {"_top": "_before"}, F.max)
        inside = F.max("_v").over(self.w.rowsBetween(Window.unboundedPreceding, 0))
        out = frame.withColumn("_in", inside).join(before, ["_key", "_blk"], "left")
        out = out.withColumn(name, F.greatest("_in", "_before")).drop("_v", "_in", "_before")
        return self._with(out)


def _carried(ends: DataFrame, decays: dict[str, float], size: int) -> DataFrame:
    """What earlier blocks add to the recursive averages of a block, as at the position before it.

    A block weighs more than 1e-16 in a few blocks after it only; it is sent to those and summed up there.
    """
    reach = {n: max(1, math.ceil(37 / (-math.log(d) * size))) for n, d in decays.items()}
    left = F.col("_blk") * size + size - 1 - F.col("_end")  # rows from the last own row to the block's end
    ends = ends.withColumns({f"_{n}_in": F.coalesce(f"_{n}_in", F.lit(0.0)) * F.pow(F.lit(d), left) for n, d in decays.items()})
    sent = ends.withColumn("_after", F.explode(F.sequence(F.lit(1), F.lit(max(reach.values())))))
    aged = {n: F.when(F.col("_after") <= reach[n], F.col(f"_{n}_in") * F.pow(F.lit(d), (F.col("_after") - 1) * size)) for n, d in decays.items()}
    sent = sent.select("_key", (F.col("_blk") + F.col("_after")).alias("_blk"), *(x.alias(f"_{n}_carry") for n, x in aged.items()))
    return sent.groupBy("_key", "_blk").agg(*(F.sum(f"_{n}_carry").alias(f"_{n}_carry") for n in decays))


#: Blocks whose summaries meet in one task; groups of so many blocks have a summary themselves.
GROUP = 1024


def scan_blocks(ends: DataFrame, names: dict[str, str], agg) -> DataFrame:
    """_key, _blk and, for every name -> output, the sum or maximum (``agg``) over the key's blocks before.

    In two levels: over the blocks before in a group of blocks, and over the groups before.
    """
    ends = ends.withColumn("_grp", F.floor(F.col("_blk") / GROUP))
    before = lambda *part: Window.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = ends.select("_key", "_blk", "_grp", *(agg(n).over(before("_key", "_grp", "_blk")).alias(f"{n}_1") for n in names))
    groups = ends.groupBy("_key", "_grp").agg(*(agg(n).alias(n) for n in names))
    above = groups.select("_key", "_grp", *(agg(n).over(before("_key", "_grp")).alias(f"{n}_2") for n in names))
    both = inside.join(above, ["_key", "_grp"])
    add = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if agg is F.sum else F.greatest
    return both.select("_key", "_blk", *(add(F.col(f"{n}_1"), F.col(f"{n}_2")).alias(out) for n, out in names.items()))


def ewm_term(c: str, alpha: float, start: int = 0) -> tuple[Column, float]:
    """Term and decay of the recursive average seeded with the value at position ``start``."""
    x, t = F.col(c), F.col("_t")
    term = F.when(t == start, x).when(t > start, x * alpha)
    return term, 1 - alpha


def span_term(c: str, span: int) -> tuple[Column, float]:
    """The recursive average of a given span: alpha = 2 / (span + 1)."""
    return ewm_term(c, 2.0 / (span + 1))
