"""Trading halts: a state machine over outcomes, folded in parallel by composable summaries.

Failures add up until a probe succeeds; from the limit on trading is halted. Attempts during a halt are blocked and
change nothing. The first attempt after the cool-down is a probe: success resumes trading and clears the count,
failure starts a new halt.

Between two outcomes a symbol is either closed with a count below the limit, or open since its last failure. A run of
outcomes therefore maps a few closed states and one interval of last failures for each outcome that can be the first
probe (those within a cool-down of the run's start) to the state after the run. Such maps compose, so they are made
for every block of rows, combined level by level, and read back from the top: every block learns the state that it
starts with and writes its changes. No group holds more rows than a block or more maps than ``FAN``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.positions import number_sorted
from barloom.sources.stage import stage

# Failures that stop trading, and the cool-down in seconds.
HALT = {"failures": 5, "cooldown": 300}

#: Rows of a block, and maps that are combined at once.
BLOCK = 4096
FAN = 16

#: What is known of a symbol between two outcomes; ``last`` is the time of its last failure in microseconds.
STATE = "symbol string, is_open boolean, failures long, last long"
ENTRY = "symbol string, block long, is_open boolean, failures long, last long"
CHANGE = "symbol string, time timestamp, seq long, state string, failures int"

# A map, row by row. Entries: closed with ``entry`` failures, or open (``entry`` null) with a last failure before ``upto`` and not
# before that of the row before. Exits: open since ``last`` or closed, with ``n`` failures, to which those at the entry are added where
# ``adds``. ``begins`` is the time of the first outcome.
MAP = "symbol string, block long, begins long, entry long, upto long, is_open boolean, last long, n long, adds boolean"
_NAMES = [c.split()[0] for c in MAP.split(", ")]


def halt_changes(
    outcomes: DataFrame, state: DataFrame | None = None, failures: int = HALT["failures"], cooldown: int = HALT["cooldown"],
    block: int | None = None, fan: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """State changes of outcomes (symbol, time, seq, ok), and the state of every symbol after them.

    ``state`` is the state before them (``STATE``, one row per symbol); symbols without one are closed with no
    failures. Changes: symbol, time, seq, state (OPEN, HALF_OPEN, CLOSED), failures. A null ``ok`` is a failure, a null
    symbol is a symbol of its own; outcomes without a time have no place in the order and are left out. Outcomes not later than
    the last failure of a symbol that is open are blocked, in whatever order they come.

    A group holds a block of rows, or ``fan`` maps. A map has a row for every outcome within a cool-down of its start
    at most, so memory depends on a symbol's outcomes in one cool-down, not on how many it has.
    """
    block, fan, pause = block or BLOCK, fan or FAN, cooldown * 1_000_000
    at = F.unix_micros(F.col("time").cast("timestamp")).alias("at")
    rows = outcomes.filter(F.col("time").isNotNull()).select("symbol", at, F.col("seq").cast("long").alias("seq"), F.coalesce("ok", F.lit(False)).alias("ok"))
    if state is not None:
        old = state.filter("is_open").select(F.col("symbol").alias("_symbol"), F.col("last").alias("_last"))
        rows = rows.join(old, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("at") <= F.col("_last")), "left_anti")
    rows = stage(number_sorted(rows, ["symbol"], ["at", "seq", "ok"]).withColumn("block", F.floor(F.col("_t") / block)).drop("_t"), "outcomes")
    levels = [stage(rows.groupBy("symbol", "block").applyInArrow(_mapping(failures, pause), MAP), "maps")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:  # until every symbol is one map
        parts = levels[-1].withColumn("whole", F.floor(F.col("block") / fan))
        levels.append(stage(parts.groupBy("symbol", "whole").applyInArrow(_joined, MAP), "maps"))
    first = stage(_before(levels[-1], state), "entries")
    entries = first
    for parts in levels[-2::-1]:  # from the top: the state before a map gives those before its parts
        parts = parts.withColumn("whole", F.floor(F.col("block") / fan))
        above = entries.withColumnRenamed("block", "whole")
        found = parts.groupBy("symbol", "whole").cogroup(above.groupBy("symbol", "whole")).applyInArrow(_passed, ENTRY)
        entries = stage(found, "entries")
    changes = rows.groupBy("symbol", "block").cogroup(entries.groupBy("symbol", "block")).applyInArrow(_telling(failures, pause), CHANGE)
    after = levels[-1].groupBy("symbol").cogroup(first.groupBy("symbol")).applyInArrow(_ended, STATE)
    if state is not None:
        same = F.col("symbol").eqNullSafe(F.col("_symbol"))
        after = after.unionByName(state.join(first.select(F.col("symbol").alias("_symbol")), same, "left_anti"))
    return changes, after


def _before(top: DataFrame, state: DataFrame | None) -> DataFrame:
    """The state before the first outcome of every symbol."""
    here = top.select("symbol", "block").distinct()
    if state is None:
        return here.select("symbol", "block", F.lit(False).alias("is_open"), F.lit(0).cast("long").alias("failures"), F.lit(0).cast("long").alias("last"))
    old = state.select(F.col("symbol").alias("_symbol"), "is_open", "failures", "last")
    known = here.join(old, F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
    return known.select("symbol", "block", F.coalesce("is_open", F.lit(False)).alias("is_open"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("failures", "last")))


# -- maps ----------------------------------------------------------------------------------------


class Exits:
    """States after a run: arrays of is_open, last, n and adds."""

    def __init__(self, is_open, last, n, adds):
        self.is_open, self.last, self.n, self.adds = is_open, last, n, adds

    def of(self, which) -> Exits:
        return Exits(self.is_open[which], self.last[which], self.n[which], self.adds[which])

    def then(self, second: Exits) -> Exits:
        """The exits after a second run whose exits, for these states, are ``second``."""
        return Exits(second.is_open, second.last, np.where(second.adds, self.n, 0) + second.n, self.adds & second.adds)


def _both(a: Exits, b: Exits) -> Exits:
    return Exits(*(np.concatenate([getattr(a, x), getattr(b, x)]) for x in ("is_open", "last", "n", "adds")))


class Map:
    """What a run of outcomes does to any state: exits for closed states by count, and for open ones by last failure."""

    def __init__(self, begins: int, closed: Exits, upto: np.ndarray, opened: Exits):
        self.begins, self.closed, self.upto, self.opened = begins, closed, upto, opened

    @classmethod
    def of_run(cls, at: np.ndarray, ok: np.ndarray, failures: int, pause: int) -> Map:
        """The map of outcomes in order.

        Two chains meet in it: a count that starts anew after outcome i reaches the limit at a known later failure, and a
        halt since failure i has a known probe. Both are followed to their ends for all i at once, by doubling.
        """
        size, bad = len(at), np.flatnonzero(~ok)
        seen = np.cumsum(~ok)  # failures up to and with each outcome
        end, adds, n = np.arange(2 * size), np.ones(2 * size, bool), np.zeros(2 * size, np.int64)  # halted since i; closed since i
        probe = np.searchsorted(at, at + pause, "right")
        has = np.flatnonzero(probe < size)
        good = ok[probe[has]]
        end[has] = np.where(good, size + probe[has], probe[has])
        adds[has], n[has] = ~good, np.where(good, 0, 1)
        limit = seen + failures - 1
        full = np.flatnonzero(limit < len(bad))
        end[size + full], adds[size + full], n[size + full] = bad[limit[full]], False, failures
        for _ in range(max(1, 2 * size).bit_length()):
            n, adds = np.where(adds[end], n, 0) + n[end], adds & adds[end]
            end = end[end]
        halted = end < size
        where = np.where(halted, end, end - size)
        final = Exits(halted, np.where(halted, at[where], 0), n + np.where(halted, 0, len(bad) - seen[where]), adds)

        count = np.arange(failures)
        left = count + len(bad) < failures
        first = bad[np.where(left, 0, failures - 1 - count)] if len(bad) else np.zeros(failures, np.int64)
        after = Exits(np.ones(failures, bool), at[first], np.full(failures, failures), np.zeros(failures, bool)).then(final.of(first))
        stays = Exits(np.zeros(failures, bool), np.zeros(failures, np.int64), count + len(bad), np.zeros(failures, bool))
        closed = Exits(*(np.where(left, getattr(stays, x), getattr(after, x)) for x in ("is_open", "last", "n", "adds")))

        reach = min(size, int(probe[0]) + 1)
        good = ok[:reach]
        probed = Exits(~good, np.where(good, 0, at[:reach]), np.where(good, 0, 1), ~good)
        opened = probed.then(final.of(np.where(good, size, 0) + np.arange(reach)))
        return cls(int(at[0]), closed, at[:reach] - pause, opened).short()

    def short(self) -> Map:
        """Neighbouring entries with the same exit are one."""
        o = self.opened
        if len(self.upto) > 1:
            same = [getattr(o, x)[1:] == getattr(o, x)[:-1] for x in ("is_open", "last", "n", "adds")]
            keep = np.append(~np.logical_and.reduce(same), True)
            self.upto, self.opened = self.upto[keep], o.of(keep)
        return self

    def __call__(self, states: Exits) -> Exits:
        """States after this run."""
        found = np.searchsorted(self.upto, states.last, "right")
        out = Exits(states.is_open.copy(), states.last.copy(), states.n.copy(), states.adds.copy())
        for of, exits, place in (
            (np.flatnonzero(states.is_open & (found < len(self.upto))), self.opened, found),
            (np.flatnonzero(~states.is_open), self.closed, states.n),
        ):
            new = states.of(of).then(exits.of(place[of]))
            out.is_open[of], out.last[of], out.n[of], out.adds[of] = new.is_open, new.last, new.n, new.adds
        return out

    def then(self, second: Map) -> Map:
        """This run and then another."""
        rest = np.flatnonzero(second.upto > (self.upto[-1] if len(self.upto) else -(1 << 62)))
        if len(rest):  # a halt that this run leaves alone began before this run: not all that the second knows
            rest = rest[: 1 + int(np.searchsorted(second.upto[rest], self.begins, "right"))]
        opened = _both(second(self.opened), second.opened.of(rest))
        return Map(self.begins, second(self.closed), np.concatenate([self.upto, second.upto[rest]]), opened).short()

    def table(self, symbol, block: int) -> pa.Table:
        exits = _both(self.closed, self.opened)
        k, size = len(self.closed.n), len(exits.n)
        entry = pa.array(np.arange(size), pa.int64(), mask=np.arange(size) >= k)
        upto = pa.array(np.concatenate([np.zeros(k, np.int64), self.upto]), mask=np.arange(size) < k)
        symbols = pa.array([symbol] * size, pa.string())
        columns = [symbols, pa.array(np.full(size, block)), pa.array(np.full(size, self.begins)), entry, upto]
        return pa.table([*columns, *(pa.array(x) for x in (exits.is_open, exits.last, exits.n, exits.adds))], names=_NAMES)

    @staticmethod
    def read(rows: pa.Table) -> list[tuple[int, Map]]:
        """(block, map) in order of blocks."""
        rows = rows.sort_by([("block", "ascending"), ("entry", "ascending"), ("upto", "ascending")])  # nulls last
        block = rows.column("block").to_numpy()
        exits = Exits(*(rows.column(c).to_numpy() for c in ("is_open", "last", "n", "adds")))
        begins, opens = rows.column("begins").to_numpy(), rows.column("entry").is_null().to_numpy()
        upto = rows.column("upto").fill_null(0).to_numpy()
        edges = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
        out = []
        for a, b in zip(edges, np.append(edges[1:], len(block)), strict=True):
            middle = a + int(np.argmax(opens[a:b])) if opens[a:b].any() else b
            out.append((int(block[a]), Map(int(begins[a]), exits.of(slice(a, middle)), upto[middle:b], exits.of(slice(middle, b)))))
        return out


# -- work on groups ------------------------------------------------------------------------------


def _outcomes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.sort_by([("at", "ascending"), ("seq", "ascending"), ("ok", "ascending")])
    return rows.column("at").to_numpy(), rows.column("ok").to_numpy(zero_copy_only=False), rows.column("seq")


def _mapping(failures: int, pause: int):
    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at, ok, _ = _outcomes(rows)
        return Map.of_run(at, ok, failures, pause).table(key[0].as_py(), key[1].as_py())

    return work


def _joined(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    maps = [m for _, m in Map.read(rows)]
    out = maps[0]
    for m in maps[1:]:
        out = out.then(m)
    return out.table(key[0].as_py(), key[1].as_py())


def _state(entry: pa.Table) -> Exits:
    return Exits(*(np.array(entry.column(c).to_pylist(), t) for c, t in (("is_open", bool), ("last", np.int64), ("failures", np.int64))), np.ones(entry.num_rows, bool))


def _passed(key: tuple[pa.Scalar, ...], parts: pa.Table, entry: pa.Table) -> pa.Table:
    """The state before each part, from that before the whole."""
    state, out = _state(entry), []
    for block, m in Map.read(parts):
        out.append((key[0].as_py(), block, bool(state.is_open[0]), int(state.n[0]), int(state.last[0])))
        state = m(state)
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ENTRY.split(", ")])


def _ended(key: tuple[pa.Scalar, ...], top: pa.Table, entry: pa.Table) -> pa.Table:
    state = Map.read(top)[0][1](_state(entry))
    return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "is_open": state.is_open, "failures": state.n, "last": state.last})


def _telling(failures: int, pause: int):
    """The changes of a block: from one to the next, whatever lies between."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table, entry: pa.Table) -> pa.Table:
        at, ok, seq = _outcomes(rows)
        bad, state = np.flatnonzero(~ok), _state(entry)
        is_open, last, n = bool(state.is_open[0]), int(state.last[0]), int(state.n[0])
        told, here = [], 0
        while True:
            if is_open:
                here = max(here, int(np.searchsorted(at, last + pause, "right")))
                if here >= len(at):
                    break
                told.append((here, "HALF_OPEN", n))
                is_open, n = not ok[here], 0 if ok[here] else n + 1
            else:
                nth = int(np.searchsorted(bad, here)) + failures - 1 - n
                if nth >= len(bad):
                    break
                here, is_open, n = int(bad[nth]), True, failures
            told.append((here, "OPEN" if is_open else "CLOSED", n))
            last, here = int(at[here]), here + 1
        place = np.array([t[0] for t in told], np.int64)
        times = pa.array(at[place], pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.table({
            "symbol": pa.array([key[0].as_py()] * len(told), pa.string()), "time": times, "seq": seq.take(pa.array(place)).combine_chunks(),
            "state": pa.array([t[1] for t in told], pa.string()), "failures": pa.array([t[2] for t in told], pa.int32()),
        })

    return work
