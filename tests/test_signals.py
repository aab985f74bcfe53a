"""Screening, fusion, sizing, risk rules, tiers, taxonomy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import context as CX
from barloom.operators import latest as L
from barloom.operators import screen as SCR
from barloom.operators import signals as SG
from barloom.operators import taxonomy as TX
from barloom.operators import universe as U
from tests.helpers import random_bars, to_spark


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


@pytest.mark.parametrize(
    "x,want", [(0.7, "STRONG_BUY"), (0.69, "BUY"), (0.3, "BUY"), (0.29, "HOLD"), (-0.3, "SELL"), (-0.7, "STRONG_SELL"), (0.0, "HOLD")]
)
def test_action_bounds(spark, x, want):
    assert one(spark, a=SG.action(F.lit(x))).a == want


def kelly(signal, conf, ret, vol):
    p = min(max(0.5 + signal * 0.25 * conf, 0.3), 0.7)
    b = min(max(ret / vol, 0.5), 3.0)
    return min(max((p * b - (1 - p)) / b * 0.5, 0.0), 0.1) * conf


@pytest.mark.parametrize("args", [(0.9, 0.9, 0.05, 0.02), (-0.9, 1.0, 0.05, 0.02), (0.2, 0.4, -0.1, 0.02), (1.0, 1.0, 0.01, 0.05)])
def test_position_size(spark, args):
    got = one(spark, s=SG.position_size(*(F.lit(float(a)) for a in args))).s
    assert abs(got - kelly(*args)) < 1e-12


def test_no_volatility_means_no_size(spark):
    assert one(spark, s=SG.position_size(F.lit(0.5), F.lit(1.0), F.lit(0.1), F.lit(0.0))).s is None


def test_regimes(spark):
    rows = [("TRENDING", 0.3 * np.tanh(1) + 0.5 * 0.6 + 0.2 * 0.1), ("unknown", 0.35 * np.tanh(1) + 0.4 * 0.6 + 0.25 * 0.1), (None, 0.35 * np.tanh(1) + 0.4 * 0.6 + 0.25 * 0.1)]
    df = spark.createDataFrame([(r,) for r, _ in rows], "regime string")
    df = df.withColumns({"technical": F.lit(1.0), "trend_probability": F.lit(0.8), "weighted_sentiment": F.lit(0.1)})
    for r, (_, want) in zip(SG.fuse(df).collect(), rows):
        assert abs(r.composite_signal - want) < 1e-12


def test_orders_first_failing_rule(spark):
    orders = spark.createDataFrame(
        [("p", "s", 200.0, 11), ("p", "s", 50.0, 11), ("p", "t", 50.0, 11), ("q", "t", 50.0, 11), ("r", "t", 50.0, 11), ("v", "t", 50.0, 11)],
        "portfolio string, sector string, value double, quantity int",
    )
    pf = spark.createDataFrame(
        [("p", 1000.0, 0.0, 10.0), ("q", 1000.0, -21.0, 10.0), ("r", 1000.0, -20.0, 30.0), ("v", 1000.0, 0.0, 30.5)],
        "portfolio string, total_value double, daily_pnl double, vix double",
    )
    held = spark.createDataFrame([("p", "s", 260.0)], "portfolio string, sector string, sector_value double")
    got = {(r.portfolio, r.sector, r.value): (r.decision, r.reason, r.adj_quantity) for r in SG.validate_orders(orders, pf, held).collect()}
    assert got[("p", "s", 200.0)] == ("REJECTED", "Position size exceeds limit", 0)
    assert got[("p", "s", 50.0)] == ("REJECTED", "Sector exposure exceeds limit", 0)
    assert got[("p", "t", 50.0)] == ("APPROVED", None, 11)
    assert got[("q", "t", 50.0)] == ("REJECTED", "Daily loss limit reached", 0)
    assert got[("r", "t", 50.0)] == ("APPROVED", None, 11)  # index exactly at its bound
    assert got[("v", "t", 50.0)] == ("APPROVED", None, 5)


def test_trailing_stop(spark):
    bars = random_bars(("A",), 120)
    e = spark.createDataFrame([("A", bars.time[20].to_pydatetime(), 100.0)], "symbol string, entry_time timestamp_ntz, entry_price double")
    got = SG.trailing_stops(to_spark(spark, bars), e, size=16).toPandas().sort_values("time")
    np.testing.assert_allclose(got.trailing_stop, bars.high[20:].cummax() * 0.97)
    assert (got.hit.to_numpy() == (bars.low[20:] <= np.maximum(95.0, bars.high[20:].cummax() * 0.97)).to_numpy()).all()


@pytest.mark.parametrize(
    "utc,status",
    [("2024-01-06 15:00:00", "CLOSED"), ("2024-01-05 14:29:00", "PRE_MARKET"), ("2024-01-05 14:30:00", "OPEN"), ("2024-01-05 21:00:00", "AFTER_HOURS"),
     ("2024-07-05 13:30:00", "OPEN"), ("2024-07-05 13:29:59", "PRE_MARKET")],
)
def test_market_status_follows_daylight_saving(spark, utc, status):
    t = F.lit(utc).cast("timestamp")
    r = one(spark, s=SG.market_status(t), o=SG.is_market_hours(t))
    assert r.s == status and r.o == (status == "OPEN")


def test_zscores_and_ranks(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"symbol": [f"S{i:02d}" for i in range(30)] * 2, "time": np.repeat(pd.to_datetime(["2024-01-01", "2024-01-02"]), 30),
                        "momentum_5": rng.normal(size=60), "volume_ratio": 1.0})
    got = SCR.screen(to_spark(spark, pdf)).toPandas()
    assert len(got) == 40 and (got.z_volume_ratio == 0).all()
    for _, g in got.groupby("time"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and g.composite_score.is_monotonic_decreasing
    z = SCR.zscores(to_spark(spark, pdf), ["momentum_5"]).toPandas()
    d = pdf.groupby("time").momentum_5
    want = ((pdf.momentum_5 - d.transform("mean")) / d.transform("std")).sort_values()
    np.testing.assert_allclose(np.sort(z.z_momentum_5), want)


def test_trailing_percentile(spark):
    bars = random_bars(("A",), 90)
    got = SCR.trailing_percentile(to_spark(spark, bars), "close", "p", 20, size=16).toPandas().sort_values("time")
    want = [np.nan] + [float((bars.close[max(0, i - 19) : i + 1] < bars.close[i]).sum()) / min(19, i) for i in range(1, 90)]
    np.testing.assert_allclose(got.p.to_numpy(dtype=float), want)


@pytest.mark.parametrize("cap,tier", [(None, "unknown"), (0.0, "unknown"), (200e9, "mega"), (10e9, "large"), (2e9, "mid"), (3e8, "small"), (5e7, "micro"), (1.0, "nano")])
def test_cap_tier(spark, cap, tier):
    assert one(spark, t=U.cap_tier(F.lit(cap).cast("double"))).t == tier


def test_liquidity_tiers(spark):
    rows = [("new", 25000.0, 1.0, 1.0, 500), ("penny", 50000.0, 9.0, 4.9, 501), ("blue", 5e5, 20.0, 20.0, 1000), ("mid", 1e5, 5.0, 5.0, 501), ("none", 1.0, 5.0, 5.0, 10)]
    df = spark.createDataFrame(rows, "symbol string, avg_volume double, avg_price double, current_price double, history_days int")
    got = {r.symbol: r.tier for r in U.liquidity_tier(df).collect()}
    assert got == {"new": "new_listings", "penny": "penny_stocks", "blue": "blue_chip", "mid": "mid_cap", "none": None}
    assert {r.symbol for r in U.in_tier(U.liquidity_tier(df)).collect()} == {"new", "penny", "blue", "mid"}


def test_taxonomy(spark):
    rows = [("a", "Tech", "Oil & Gas E&P"), ("b", "", "Software—Application"), ("c", None, None), ("d", "nope", "  "), ("e", "UTILITY", "bank")]
    df = spark.createDataFrame(rows, "symbol string, sector string, industry string")
    got = {r.symbol: (r.sector_id, r.industry_id, r.sector_name, r.industry_name) for r in TX.classify(df).collect()}
    assert got["a"] == (0, 42, "Tech", "Oil & Gas E&P")
    assert got["b"] == (0, 0, "Information Technology", "Software—Application")
    assert got["c"] == (-1, -1, "Unknown", "Unknown")
    assert got["d"][:2] == (0, 0)  # blank text is part of every name: the first one wins, and gives the sector
    assert got["e"] == (7, 12, "UTILITY", "bank")
    assert len(TX.INDUSTRIES) == 69
    rel = TX.related_symbols(spark.createDataFrame([("DIS",)], "symbol string"))
    assert {r.related for r in rel.collect()} == {"NFLX", "PARA"}
    assert TX.delisting_list(spark, "history").filter("delist_year is null").count() == 2


def test_forward_fill_and_context(spark):
    bars = random_bars(("x", "y"), 100, seed=4)
    bars = bars[~((bars.symbol == "y") & (bars.time.dt.day % 3 == 0))]
    got = CX.market_context(to_spark(spark, bars), ["x", "y"]).toPandas().sort_values("time")
    want = bars.pivot(index="time", columns="symbol", values="close").ffill()
    np.testing.assert_allclose(got.y_close.to_numpy(dtype=float), want.y.to_numpy())
    stock = random_bars(("S",), 130, seed=9)
    ctx = CX.market_context(to_spark(spark, bars), ["x", "y"])
    t = CX.training_features(to_spark(spark, stock), ctx).toPandas().sort_values("time")
    np.testing.assert_allclose(t.x_close.to_numpy()[-30:], want.x.iloc[-1])


def test_latest(spark):
    bars = random_bars(("A", "B"), 30)
    df = to_spark(spark, bars)
    assert L.last_n(df, 3, order=("time",)).count() == 6
    assert L.latest_price(df, "A").first().close == bars[bars.symbol == "A"].close.iloc[-1]
    assert L.retain(df, "market_ticks", as_of="2015-01-20 00:00:00").count() == 2 * 18
    assert L.latest_row(df, order=("time",)).count() == 2
