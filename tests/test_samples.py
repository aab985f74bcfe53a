"""Targets, sequences, labels, splits, statistics and metrics on small fixtures."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics as M
from barloom.operators import samples as S
from barloom.operators import stats as ST
from tests.helpers import random_bars, to_spark

SIZE = 32


@pytest.fixture(scope="module")
def bars():
    return pd.concat(
        [random_bars(("A",), 150, seed=1), random_bars(("B",), 40, seed=2), random_bars(("C",), 5, seed=3)], ignore_index=True
    )


def test_targets(spark, bars):
    got = S.add_targets(to_spark(spark, bars), size=SIZE).toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    r = bars.groupby("symbol").close.shift(-5) / bars.close - 1
    np.testing.assert_allclose(got.target_return_5d, r.to_numpy())
    d = np.where(r > 0.02, 1, np.where(r < -0.02, -1, 0))
    assert (got.target_direction_5d == d).all() and (got.target_up_5d == (r > 0)).all()


def test_sequences_match_slices_and_stay_in_their_symbol(spark, bars):
    df = to_spark(spark, bars).withColumn("y", F.col("volume").cast("double"))
    df = df.withColumn("close", F.when(F.dayofmonth("time") != 13, F.col("close")))  # holes are dropped
    got = S.sequences(df, ["close", "high"], "y", 10, size=SIZE).toPandas()
    n = 0
    for s, g in bars.groupby("symbol"):
        g = g[g.time.dt.day != 13].reset_index(drop=True)
        n += max(0, len(g) - 10)
        for i in range(len(g) - 10):
            row = got[(got.symbol == s) & (got.time == g.time[i + 10])].iloc[0]
            assert row.y == g.volume[i + 10]
            np.testing.assert_allclose(np.array([list(r) for r in row.x]), g.loc[i : i + 9, ["close", "high"]].to_numpy())
    assert len(got) == n


def test_windows_and_multiplicity(spark, bars):
    df = to_spark(spark, bars)
    got = S.windows(df, ["close"], 20, 3, size=SIZE).toPandas()
    counts = got.groupby("symbol").size()
    assert counts["A"] == 150 - 20 - 3 and counts["B"] == 40 - 20 - 3 and "C" not in counts
    g = bars[bars.symbol == "A"].reset_index(drop=True)
    row = got[(got.symbol == "A") & (got.time == g.time[19])].iloc[0]
    np.testing.assert_allclose(row.target_returns, g.close[20:23] / g.close[19] - 1)
    assert list(row.target_direction) == [float(x > 0) for x in row.target_returns]
    # rows weighted by their windows give the statistics of all windows together
    pool = np.concatenate([np.array([v[0] for v in x]) for x in got.x])
    weighted = ST.stats_long(S.window_multiplicity(df, 20, 3), ["close"], F.col("n_windows")).first()
    np.testing.assert_allclose([weighted["mean"], weighted["std"]], [pool.mean(), pool.std() + 1e-8], rtol=1e-10)


def test_delisting_labels_grow_with_the_horizon(spark, bars):
    meta = spark.createDataFrame([("A", "fraud", 1), ("A", "other", 2), ("B", "bankruptcy", 3), ("C", "x", 4)],
                                 "symbol string, delist_reason string, meta_order int")
    got = S.delisting_labels(to_spark(spark, bars), meta).toPandas()
    assert len(got) == len(bars) and set(got[got.symbol == "A"].delist_reason) == {"fraud"}
    assert (got.delist_30d <= got.delist_90d).all() and (got.delist_90d <= got.delist_180d).all()
    a = got[got.symbol == "A"].sort_values("date")
    assert list(a.days_to_delist) == list(range(149, -1, -1)) and a.delist_30d.sum() == 31


def test_delisted_samples_and_union(spark, bars):
    df = to_spark(spark, bars)
    meta = spark.createDataFrame([("A", "fraud"), ("B", "x"), ("C", "y")], "symbol string, delist_reason string")
    labels = S.delisting_labels(df, meta).filter("symbol = 'A'")
    d = S.delisted_windows(df, labels, ["close"], 7, 20, 3, size=SIZE)
    both = S.with_delisted(S.windows(df, ["close"], 20, 3, size=SIZE), d).toPandas()
    assert both.is_delisted.sum() == len(both) / 2
    b = both[both.is_delisted & (both.symbol == "B")]
    assert all(list(x) == [0.0] * 4 for x in b.delist_risk) and (b.stock_idx == 7).all()


def test_splits(spark):
    df = spark.range(103).select(F.concat(F.lit("S"), "id").alias("symbol"))
    got = S.split_symbols(df.union(df)).toPandas()
    assert got.symbol.is_unique and len(got) == 103
    assert got.split.value_counts().to_dict() == {"train": 82, "val": 10, "test": 11}
    again = S.split_symbols(df).toPandas()
    assert dict(zip(got.symbol, got.split)) == dict(zip(again.symbol, again.split))
    other = S.split_symbols(df, seed=1).toPandas()
    assert dict(zip(got.symbol, got.split)) != dict(zip(other.symbol, other.split))
    idx = S.symbol_index(df).toPandas().sort_values("symbol")
    assert list(idx.stock_idx) == list(range(103))


def test_time_split_never_mixes(spark, bars):
    got = S.split_time(to_spark(spark, bars)).toPandas()
    assert got[got.split == "train"].time.max() < got[got.split == "val"].time.min()


def test_normalisation_styles(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, flat double")
    st = ST.fit_stats(df, ["a", "flat"])
    train = ST.apply_stats(df, st, ["a", "flat", "missing"]).toPandas()
    np.testing.assert_allclose(train.a.dropna(), [-(0.5**0.5), 0.5**0.5])
    assert (train.flat == 0).all()
    live = ST.apply_stats(df.withColumn("flat", F.lit(7.0)), st, ["a", "flat"], style="live").toPandas()
    assert (live.flat == 2).all()


def test_quality(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 4, 1.0).alias("a"), F.when(F.col("id") >= 10, 1.0).alias("b"), F.when(F.col("id") >= 30, 1.0).alias("c")
    )
    got = {r.column_name: (r.null_pct, r.status) for r in ST.null_share(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (4.0, "OK"), "b": (10.0, "WARN"), "c": (30.0, "ERROR")}


def test_regression_and_horizon_metrics(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, p double")
    r = M.regression_metrics(df).first()
    np.testing.assert_allclose(
        [r.mse, r.rmse, r.mae, r.correlation, r.direction_accuracy],
        [np.mean((y - p) ** 2), np.sqrt(np.mean((y - p) ** 2)), np.mean(abs(y - p)), np.corrcoef(y, p)[0, 1], np.mean(np.sign(y) == np.sign(p))],
    )
    arrays = df.select(F.array("y", F.lit(1.0)).alias("y"), F.array("p", F.lit(1.0)).alias("p"))
    days = {d.day: d for d in M.horizon_metrics(arrays).collect()}
    assert days[2].correlation == 0.0 and days[2].direction_accuracy == 1.0
    np.testing.assert_allclose(days[1].correlation, np.corrcoef(y, p)[0, 1])


def test_losses_do_not_overflow(spark):
    df = spark.createDataFrame([(1.0, 800.0, 0.1, 1.0, 0.0, True), (-1.0, -800.0, 0.1, 0.0, 0.0, False)],
                               "y double, mu double, sigma double, delist_p double, delist_y double, is_delisted boolean")
    r = M.loss_metrics(df).first()
    assert r.direction_bce == 0.0 and r.delist_bce == 5 * 100 / 2


def test_vector_losses_count_every_element(spark):
    rows = [([0.1, -0.2], [0.3, 0.1], [0.5, 0.4], [0.2, 0.7, 0.1, 0.9], [0.0, 1.0, 0.0, 1.0], True),
            ([0.0, 0.2], [-0.3, 0.1], [0.2, 0.4], [0.1, 0.1, 0.1, 0.1], [0.0, 0.0, 0.0, 1.0], False)]
    df = spark.createDataFrame(rows, "y array<double>, mu array<double>, sigma array<double>, delist_p array<double>, delist_y array<double>, is_delisted boolean")
    r = M.loss_metrics(df).first()
    y, mu, sg, p, t = (np.array([row[i] for row in rows]) for i in range(5))
    up = (y > 0).astype(float)
    ce = -(t * np.log(p) + (1 - t) * np.log(1 - p)) * np.array([[5.0], [1.0]])
    want = [
        ((mu - y) ** 2).mean(),
        (np.log1p(np.exp(-np.abs(mu))) + np.maximum(mu, 0) - mu * up).mean(),
        (np.log(sg + 1e-8) + (mu - y) ** 2 / (2 * sg**2 + 1e-8)).mean(),
        ce.mean(),
    ]
    np.testing.assert_allclose([r.price_mse, r.direction_bce, r.uncertainty_nll, r.delist_bce], want)
    np.testing.assert_allclose(r.total_loss, want[0] + 0.5 * want[1] + 0.2 * want[2] + 0.5 * want[3])


def test_portfolio_metrics(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.0005, 0.02, 300)
    pdf = pd.DataFrame({"symbol": "P", "time": pd.date_range("2020-01-01", periods=300), "r": r})
    got = M.portfolio_metrics(to_spark(spark, pdf)).first()
    wealth = np.concatenate([[1.0], np.cumprod(1 + r)])
    drop = (1 - wealth / np.maximum.accumulate(wealth)).max()
    np.testing.assert_allclose(
        [got.total_return, got.max_drawdown, got.win_rate, got.sharpe_ratio, got.profit_factor],
        [wealth[-1] - 1, drop, np.mean(r > 0), r.mean() / r.std(ddof=1) * np.sqrt(252), r[r > 0].sum() / -r[r < 0].sum()],
    )


def test_borders_by_counts(spark, monkeypatch):
    """Few rows are ordered at once, so the borders are found over several rounds of counts."""
    import hashlib

    monkeypatch.setattr(S, "FEW", 2)
    monkeypatch.setattr(S, "DIGITS", 1)
    names = [None, "", *(f"S{i}" for i in range(150))]
    got = {r.symbol: r.split for r in S.split_symbols(spark.createDataFrame([(x,) for x in names * 2], "symbol string"), seed=7).collect()}
    order = sorted(names, key=lambda s: (hashlib.md5(f"7:{s or ''}".encode()).hexdigest(), s is not None, s or ""))
    n, a, b = len(names), int(len(names) * 0.8), int(len(names) * 0.1)
    assert got == {s: "train" if i < a else "val" if i < a + b else "test" for i, s in enumerate(order)} and len(got) == n
    ts = [datetime(2024, 1, 1) + timedelta(seconds=i * i * 7) for i in range(300)] + [datetime(2024, 1, 1, 0, 0, 0, i) for i in range(1, 9)]
    df = spark.createDataFrame([(t,) for t in [*ts, *ts, None]], "time timestamp_ntz")
    for share in (0.0, 0.01, 0.8, 1.0):
        cut = sorted(ts)[int(len(ts) * share)] if share < 1 else datetime.max
        rows = S.split_time(df, share).collect()
        assert all(r.split == ("train" if r.time is not None and r.time < cut else "val") for r in rows) and len(rows) == 617
