"""Halts folded in parallel equal the plain state machine, however the outcomes are cut."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.positions import number_sorted
from barloom.operators import halts as H

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp, seq bigint, ok boolean"


def plain(rows, states, failures, cooldown):
    """One outcome after the other."""
    out = []
    for symbol, time, seq, ok in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2], r[3] or False)):
        mode, n, last = states.get(symbol, ("CLOSED", 0, None))
        if mode == "OPEN":
            if time - last <= timedelta(seconds=cooldown):
                continue
            out.append((symbol, seq, "HALF_OPEN", n))
            mode = "HALF_OPEN"
        before = mode
        if ok:
            mode, n = ("CLOSED", 0) if mode == "HALF_OPEN" else (mode, n)
        else:
            n, last = n + 1, time
            mode = "OPEN" if n >= failures else mode
        if mode != before:
            out.append((symbol, seq, mode, n))
        states[symbol] = (mode, n, last)
    return sorted(out, key=str)


def outcomes(n, seed, hot=0.4, bad=0.5, gap=40):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice((0, 1, gap, 5 * gap if rng.random() < 0.1 else 2))
        symbol = "HOT" if rng.random() < hot else rng.choice(["A", "B", None])
        rows.append((symbol, START + timedelta(seconds=at), i, None if rng.random() < 0.02 else rng.random() > bad))
    return rows


@pytest.mark.parametrize("block, fan, bad", [(4096, 16, 0.5), (7, 2, 0.5), (5, 3, 0.9), (1, 2, 0.3), (64, 2, 0.1)])
def test_halts_equal_the_plain_fold(spark, block, fan, bad):
    rows = outcomes(600, block, bad=bad)
    states = {}
    want = plain(rows, states, 3, 60)
    changes, after = H.halt_changes(spark.createDataFrame(rows, SCHEMA).repartition(5), failures=3, cooldown=60, block=block, fan=fan)
    assert sorted(((r.symbol, r.seq, r.state, r.failures) for r in changes.collect()), key=str) == want and len(want) > 20
    assert {(r.symbol, r.is_open, r.failures) for r in after.collect()} == {(s, m == "OPEN", n) for s, (m, n, _) in states.items()}


def test_one_batch_or_many(spark):
    rows = outcomes(400, 3)
    states, want, state, got = {}, [], None, []
    for a in range(0, 400, 90):
        part = rows[a : a + 90]
        want += plain(part, states, 5, 300)
        changes, state = H.halt_changes(spark.createDataFrame(part, SCHEMA), state, block=16, fan=2)
        got += [(r.symbol, r.seq, r.state, r.failures) for r in changes.collect()]
        state = spark.createDataFrame(state.collect(), H.STATE)
    assert sorted(got, key=str) == sorted(want, key=str) == plain(rows, {}, 5, 300)


def test_late_outcomes_of_an_open_symbol_are_blocked(spark):
    state = spark.createDataFrame([("A", True, 5, int(START.timestamp() * 1_000_000) + 3_600_000_000)], H.STATE)
    rows = [("A", START + timedelta(seconds=s), s, True) for s in (0, 10, 3700, 3950)]
    utc = spark.createDataFrame([(a, int(t.timestamp() * 1_000_000), s, o) for a, t, s, o in rows], "symbol string, us long, seq long, ok boolean")
    changes, _ = H.halt_changes(utc.withColumn("time", F.timestamp_micros("us")), state)
    assert [(r.seq, r.state) for r in changes.orderBy("state").collect()] == [(3950, "CLOSED"), (3950, "HALF_OPEN")]


def test_no_outcomes(spark):
    none = spark.createDataFrame([], SCHEMA)
    changes, after = H.halt_changes(none)
    assert changes.count() == 0 and after.count() == 0
    state = spark.createDataFrame([("A", False, 2, 0)], H.STATE)
    assert [tuple(r) for r in H.halt_changes(none, state)[1].collect()] == [("A", False, 2, 0)]


def test_maps_compose_in_any_grouping():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n = int(rng.integers(3, 60))
        at, ok = np.cumsum(rng.integers(0, 30, n)), rng.random(n) > 0.6
        cuts = np.sort(rng.choice(np.arange(1, n), 2, replace=False))
        a, b, c = (H.Map.of_run(x, y, 3, 40) for x, y in zip(np.split(at, cuts), np.split(ok, cuts), strict=True))
        whole = H.Map.of_run(at, ok, 3, 40)
        lasts = np.arange(-60, int(at[0]) + 1)
        states = H.Exits(np.arange(len(lasts) + 3) >= 3, np.concatenate([[0, 0, 0], lasts]), np.concatenate([[0, 1, 2], np.full(len(lasts), 4)]), np.ones(len(lasts) + 3, bool))
        results = [m(states) for m in (whole, a.then(b).then(c), a.then(b.then(c)))]
        for other in results[1:]:
            for x in ("is_open", "n"):
                assert (getattr(results[0], x) == getattr(other, x)).all(), trial
            assert (results[0].last == other.last)[results[0].is_open].all()


def test_positions_over_range_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["HOT"] * 5 + ["A", None]), rng.choice([None, *range(20)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "symbol string, time int, seq long")
    got = {r.seq: r._t for r in number_sorted(df, ["symbol"], ["time", "seq"], parts=7).collect()}
    want, seen = {}, {}
    for s, _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want[i] = seen[s] = seen.get(s, -1) + 1
    assert got == want


def test_as_of_with_a_hot_moment(spark, monkeypatch):
    """Half of all ticks are one symbol's in one second; no chunk has more rows than it may, and nothing is lost."""
    import barloom.functions.positions as P
    import barloom.operators.context as C

    monkeypatch.setattr(P, "RUN", 60)
    monkeypatch.setattr(C, "ROWS", 16)
    rng = random.Random(6)

    def places(n):
        for _ in range(n):
            hot = rng.random() < 0.5
            at = rng.randrange(10**6) if hot else rng.randrange(10**11)
            yield "HOT" if hot else rng.choice(["A", None]), START + timedelta(microseconds=at)

    left = [(s, t, i) for i, (s, t) in enumerate(places(400))] + [("A", None, 1000)]
    right = [(s, t, float(i)) for i, (s, t) in enumerate(dict.fromkeys(places(300)))]
    a = spark.createDataFrame(left, "symbol string, time timestamp_ntz, seq long")
    b = spark.createDataFrame(right, "symbol string, time timestamp_ntz, quote double")
    got = {r.seq: r.quote for r in C.as_of(a, b, ["quote"]).collect()}
    for s, t, i in left:
        before = [] if t is None else [(x, q) for r, x, q in right if r == s and x <= t]
        assert got[i] == (max(before)[1] if before else None)
    both = a.select("symbol", "time").union(b.select("symbol", "time")).withColumns({"_at": F.col("time"), "_o": F.col("time")})
    assert C.chunked(both, ["symbol"], None)[0].groupBy("_g").count().agg(F.max("count")).first()[0] <= 16
    assert C.chunked(both, ["symbol"], "hour")[0].groupBy("_g").count().agg(F.max("count")).first()[0] > 200
