"""Bars: invariants, equal results by any route, and one symbol holding most ticks."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from tests.helpers import to_spark


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(11)
    n = 6000
    pdf = pd.DataFrame(
        {
            "symbol": np.where(rng.random(n) < 0.8, "HOT", "S" + pd.Series(rng.integers(0, 9, n)).astype(str)),
            "time": [datetime(2024, 1, 1) + timedelta(seconds=int(x)) for x in np.sort(rng.integers(0, 86400 * 3, n))],
            "seq": np.arange(n),
            "price": rng.uniform(90, 110, n).round(2),
            "size": rng.integers(0, 50, n),
        }
    )
    pdf["time"] = pdf["time"].astype("datetime64[us]")
    return pdf


@pytest.mark.parametrize("size,freq", [("1m", "1min"), ("5m", "5min"), ("1h", "1h"), ("1d", "1D"), ("week", "W")])
def test_bars(spark, ticks, size, freq):
    got = B.bars_from_ticks(to_spark(spark, ticks), size).toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    start = ticks.time.dt.to_period("W").dt.start_time if freq == "W" else ticks.time.dt.floor(freq)
    g = ticks.sort_values(["time", "seq"]).assign(bucket=start).groupby(["symbol", "bucket"])
    want = g.agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"),
                 volume=("size", "sum"), trade_count=("price", "size")).reset_index()
    assert (got.time.to_numpy() == want.bucket.to_numpy().astype("datetime64[ns]")).all()
    for c in ("open", "high", "low", "close", "volume", "trade_count"):
        np.testing.assert_allclose(got[c], want[c])
    assert (got.high >= got[["open", "close"]].max(axis=1)).all() and (got.low <= got[["open", "close"]].min(axis=1)).all()
    assert got.volume.sum() == ticks["size"].sum()
    assert (got.vwap.isna() == (got.volume == 0)).all()
    inside = got.vwap.dropna()
    assert ((inside <= got.high[inside.index] + 1e-9) & (inside >= got.low[inside.index] - 1e-9)).all()


def test_minutes_rolled_up_equal_hours_from_ticks(spark, ticks):
    df = to_spark(spark, ticks)
    a = B.coarser_bars(B.bars_from_ticks(df, "1m").na.fill(0.0, ["vwap"]), "1h").toPandas()
    b = B.bars_from_ticks(df, "1h").toPandas()
    a, b = (x.sort_values(["symbol", "time"]).reset_index(drop=True) for x in (a, b))
    for c in ("open", "high", "low", "close", "volume", "trade_count", "vwap"):
        np.testing.assert_allclose(a[c], b[c])


def test_one_numeric_order_column_is_a_hash_aggregate(spark, ticks):
    df = to_spark(spark, ticks)
    plan = B.bars_from_ticks(df, "1h", order=("seq",))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text
    a = plan.toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    b = B.bars_from_ticks(df, "1h").toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_dedupe_key_and_shapes(spark):
    rows = [("A", 1, 5, 1.0), ("A", 1, 3, 2.0), ("A", 2, 1, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, time int, seq int, price double")
    assert {(r.time, r.price) for r in B.dedupe_key(df).collect()} == {(1, 2.0), (2, 3.0)}
    q = spark.createDataFrame([("A", 9.0, 11.0), ("A", 0.0, 0.0)], "symbol string, bid double, ask double")
    assert B.mean_spread(q).first().avg_spread_pct == 0.2
    bar = spark.createDataFrame([(1.0, 3.0, 0.5, 2.0)], "open double, high double, low double, close double")
    r = B.bar_shape(bar).select(F.col("range"), "body", "is_bullish").first()
    assert (r[0], r.body, r.is_bullish) == (2.5, 1.0, True)
