"""Feature families against freshly written pandas forms, and edge series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import families, flow, proxy, technical
from tests import helpers as H

SIZE = 64  # several blocks per symbol


@pytest.fixture(scope="module")
def bars():
    return H.random_bars(("A", "B", "C"), 330)


def test_technical(spark, bars):
    got = technical.add_technical(H.to_spark(spark, bars), size=SIZE).toPandas()
    names = [c for c in H.technical(bars).columns if c not in bars.columns]
    H.same(got, H.technical(bars), names, rtol=1e-9, atol=1e-10)


def test_flow(spark, bars):
    got = flow.add_flow(H.to_spark(spark, bars), size=SIZE).toPandas()
    H.same(got, H.flow(bars), flow.FEATURES, rtol=1e-7, atol=1e-9)
    for c in ("accumulation_distribution", "smart_money_index", "obv_trend", "vwap_divergence"):
        assert got[c].between(-1, 1).all()


def test_proxy_with_a_gappy_market(spark, bars):
    market = H.random_bars(("ALL",), 330, seed=5)
    market = market[np.arange(len(market)) % 7 != 3]  # days without a market row
    got = proxy.add_proxy(H.to_spark(spark, bars), H.to_spark(spark, market), size=SIZE).toPandas()
    want = H.proxy(bars, market)
    names = [c for c in want.columns if c not in bars.columns]
    H.same(got, want, names, rtol=1e-7, atol=1e-9)


def test_live(spark, bars):
    got = technical.add_live(H.to_spark(spark, bars), size=SIZE).toPandas()
    want = H.live(bars)
    H.same(got, want, [c for c in want.columns if c not in bars.columns], rtol=1e-8, atol=1e-9)


def test_all_families_equal_the_single_ones(spark, bars):
    market = H.random_bars(("ALL",), 330, seed=5)
    b, m = H.to_spark(spark, bars), H.to_spark(spark, market)
    got = families.add_all(b, m, size=SIZE).toPandas()
    t = technical.add_technical(b, size=SIZE).toPandas()
    f = flow.add_flow(b, size=SIZE).toPandas()
    p = proxy.add_proxy(b, m, size=SIZE).toPandas()
    H.same(got, t, technical.FEATURES)
    H.same(got, f, flow.FEATURES)
    H.same(got, p, [*proxy.FEATURES, "sent_daily_range"])


def edge(close, high=None, low=None, volume=None):
    n = len(close)
    return pd.DataFrame(
        {
            "symbol": "E", "time": pd.date_range("2020-01-01", periods=n, freq="D"), "open": close, "high": high or close,
            "low": low or close, "close": close, "volume": volume or [100] * n,
        }
    )


def run(spark, pdf, fn):
    return fn(H.to_spark(spark, pdf)).toPandas().sort_values("time").reset_index(drop=True)


def test_constant_price(spark):
    out = run(spark, edge([10.0] * 40), technical.add_technical)
    assert out.rsi_14.isna().all()
    assert out.bb_position.isna().all() and out.position_in_range.isna().all()
    assert (out.bb_width.dropna() == 0).all()


def test_rising_price(spark):
    out = run(spark, edge([10.0 + i for i in range(40)]), technical.add_technical)
    assert out.rsi_14.isna().sum() == 13 and (out.rsi_14.dropna() == 100).all()


def test_one_row(spark):
    out = run(spark, edge([10.0]), technical.add_technical)
    assert len(out) == 1 and math.isnan(out.returns[0]) and out.ema_5[0] == 10 and out.macd_signal[0] == 0
    live = run(spark, edge([10.0]), technical.add_live)
    assert live.rsi[0] == 50 and live.atr[0] == 0 and live.bb_pct[0] == 0.5 and live.volume_ratio[0] == 1


def test_zero_volume_and_flat_bars(spark):
    vol = [0] * 30
    out = run(spark, edge([10.0 + (i % 3) for i in range(30)], volume=vol), flow.add_flow)
    assert out[list(flow.FEATURES)].notna().all().all()
    assert (out.vwap_divergence == 0).all()
    sent = run(spark, edge([10.0 + (i % 3) for i in range(30)], volume=vol), proxy.add_proxy)
    assert sent[["sentiment_proxy", "close_position"]].notna().all().all()


def test_volume_jump_from_zero_saturates(spark):
    out = run(spark, edge([10.0 + i for i in range(30)], volume=[0] * 15 + [100] * 15), flow.add_flow)
    # price up, volume change infinite: the product is clipped at its lower bound
    assert out.pv_divergence[15] == -1.0


def test_calendar_gap(spark, bars):
    """A missing week changes nothing: windows count rows, not days."""
    shifted = bars.copy()
    late = shifted.time >= "2015-06-01"
    shifted.loc[late, "time"] = shifted.loc[late, "time"] + pd.Timedelta(days=70)
    a = technical.add_technical(H.to_spark(spark, bars), size=SIZE).orderBy("symbol", "time").toPandas()
    b = technical.add_technical(H.to_spark(spark, shifted), size=SIZE).orderBy("symbol", "time").toPandas()
    np.testing.assert_allclose(a.rsi_14, b.rsi_14, rtol=1e-12)


def test_latest_signals_and_reading(spark, bars):
    f = flow.add_flow(H.to_spark(spark, bars), size=SIZE)
    got = flow.latest_signals(f).toPandas().set_index("symbol")
    want = H.flow(bars).groupby("symbol").last()
    np.testing.assert_allclose(got.smart_money_flow, want.smart_money_flow, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got.distribution_score, -got.accumulation_score)
    rows = [("a", 0.4, 0.6, 0.0), ("b", -0.4, 0.2, 0.9), ("c", 0.0, 0.0, 0.61), ("d", 0.4, 0.4, 0.1)]
    df = spark.createDataFrame(rows, "symbol string, smart_money_flow double, weak_hands_score double, short_squeeze_potential double")
    out = {r.symbol: r.reading for r in df.withColumns(flow.interpretation()).collect()}
    assert out == {"a": "accumulating", "b": "distributing", "c": "squeeze_setup", "d": "none"}


def test_short_interest_boost(spark, bars):
    b = H.to_spark(spark, bars).withColumn("si", F.when(F.col("symbol") == "A", 50.0).when(F.col("symbol") == "B", 20.0))
    plain = flow.add_flow(H.to_spark(spark, bars), size=SIZE).toPandas().sort_values(["symbol", "time"])
    got = flow.add_flow(b, short_interest="si", size=SIZE).toPandas().sort_values(["symbol", "time"])
    raw = plain.squeeze_potential.to_numpy()
    want = np.where(plain.symbol == "A", np.clip(raw * 1.5, 0, 1), raw)
    np.testing.assert_allclose(got.squeeze_potential, want, rtol=1e-12)


def test_beta(spark, bars):
    market = H.random_bars(("ALL",), 330, seed=5)
    got = technical.add_beta(H.to_spark(spark, bars), H.to_spark(spark, market), size=SIZE).toPandas()
    one = got[got.symbol == "B"].sort_values("time")
    r = (bars[bars.symbol == "B"].close / bars[bars.symbol == "B"].close.shift(1) - 1).reset_index(drop=True)
    m = (market.close / market.close.shift(1) - 1).reset_index(drop=True)
    want = r.rolling(60).cov(m) / m.rolling(60).var()
    np.testing.assert_allclose(one.beta.to_numpy(), want.to_numpy(), rtol=1e-8)


def test_column_checks_and_padding(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)], "Open double, high double, low double")
    assert families.missing_columns(df) == ["close", "volume"]
    r = df.select(families.padded(["high"], 3).alias("p"), families.padded(["Open", "high"], 2).alias("whole")).first()
    assert r.p == [2.0, 0.0, 0.0] and r.whole == [1.0, 2.0]
    with pytest.raises(ValueError):
        families.padded(["Open", "high", "low"], 2)
    assert families.present(df, ["low", "nothing"]) == ["low"]
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (0.5,)], "x double")
    from barloom.functions.expr import clip, finite

    assert [x.v for x in odd.select(finite(F.col("x")).alias("v")).collect()] == [3.0, -3.0, 0.0, 0.0, 0.5]
    assert [x.v for x in odd.select(clip(F.col("x"), -1, 1).alias("v")).collect()] == [1.0, -1.0, None, None, 0.5]
