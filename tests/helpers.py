"""Independent pandas forms of the indicator formulas, and random bars."""

from __future__ import annotations

import numpy as np
import pandas as pd


def random_bars(symbols=("A", "B"), n=400, seed=7, gaps=False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, n))
        days = pd.date_range("2015-01-01", periods=n, freq="D")
        if gaps:
            days = days[np.sort(rng.choice(n, n, replace=False))] + pd.to_timedelta(np.cumsum(rng.integers(0, 9, n)), unit="D")
        out.append(
            pd.DataFrame(
                {
                    "symbol": s, "time": days, "open": open_, "high": high, "low": low, "close": close,
                    "volume": rng.integers(1000, 90000, n),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    ddl = {"object": "string", "int64": "bigint", "float64": "double", "bool": "boolean", "datetime64[ns]": "timestamp_ntz",
           "str": "string", "datetime64[us]": "timestamp_ntz", "int32": "int"}
    schema = ", ".join(f"`{c}` {ddl[str(t)]}" for c, t in pdf.dtypes.items())
    return spark.createDataFrame(pdf, schema)


def same(got: pd.DataFrame, want: pd.DataFrame, columns, keys=("symbol", "time"), rtol=1e-9, atol=1e-9):
    g = got.sort_values(list(keys)).reset_index(drop=True)
    w = want.sort_values(list(keys)).reset_index(drop=True)
    assert len(g) == len(w)
    for c in columns:
        a, b = g[c].astype(float).to_numpy(), w[c].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), f"{c}: nulls differ at {np.flatnonzero(np.isnan(a) != np.isnan(b))[:5]}"
        np.testing.assert_allclose(a, b, rtol=rtol, atol=atol, err_msg=c)


def per_symbol(fn):
    return lambda df: pd.concat([fn(g.sort_values("time").reset_index(drop=True)) for _, g in df.groupby("symbol")])


@per_symbol
def technical(d):
    d = d.copy()
    c = d.close
    ret = c / c.shift(1) - 1
    d["returns"] = ret
    for n in (5, 10, 20, 50, 200):
        d[f"sma_{n}"] = c.rolling(n).mean()
        d[f"ema_{n}"] = c.ewm(span=n, adjust=False).mean()
    sd = c.rolling(20).std()
    d["bb_upper"], d["bb_lower"] = d.sma_20 + 2 * sd, d.sma_20 - 2 * sd
    d["bb_position"] = (c - d.bb_lower) / (d.bb_upper - d.bb_lower)
    step = c.diff()
    up = step.clip(lower=0).fillna(0).rolling(14).mean()
    down = (-step.clip(upper=0)).fillna(0).rolling(14).mean()
    d["rsi_14"] = 100 - 100 / (1 + up / down)
    d["macd"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    d["macd_signal"] = d.macd.ewm(span=9, adjust=False).mean()
    tr = np.fmax(d.high - d.low, np.fmax((d.high - c.shift(1)).abs(), (d.low - c.shift(1)).abs()))
    d["atr_14"] = tr.rolling(14).mean()
    d["volatility_20"] = ret.rolling(20).std() * np.sqrt(252)
    d["momentum_20"] = c / c.shift(20) - 1
    hi, lo = d.high.rolling(20).max(), d.low.rolling(20).min()
    d["position_in_range"] = (c - lo) / (hi - lo)
    return d


@per_symbol
def flow(d):
    d = d.copy()
    o, h, lo, c, v = d.open, d.high, d.low, d.close, d.volume.astype(float)
    vm = v.rolling(20).mean()
    d["unusual_volume"] = 1 / (1 + np.exp(-(v - vm) / (v.rolling(20).std() + 1e-8)))
    rg = (h - lo) / c
    d["block_trade_prob"] = ((v / (vm + 1)) / (rg / (rg.rolling(20).mean() + 1e-8) + 1)).clip(0, 10) / 10
    ad = ((((c - lo) - (h - c)) / (h - lo + 1e-8)).clip(-1, 1) * v).cumsum()
    d["accumulation_distribution"] = (ad.diff(5) / (ad.rolling(20).std() + 1e-8)).clip(-3, 3) / 3
    tp = (h + lo + c) / 3
    mf = tp * v
    pos, neg = mf.where(tp.diff() > 0, 0).rolling(14).sum(), mf.where(tp.diff() < 0, 0).rolling(14).sum()
    d["money_flow_index"] = (100 - 100 / (1 + pos / (neg + 1e-8))) / 100
    d["smart_money_index"] = ((c - o).cumsum().diff(5) / (c.rolling(20).std() + 1e-8)).clip(-3, 3) / 3
    vwap = mf.cumsum() / v.cumsum()
    d["vwap_divergence"] = ((c - vwap) / vwap).clip(-0.1, 0.1) * 10
    obv = (np.sign(c.diff()).fillna(0) * v).cumsum()
    d["obv_trend"] = ((obv - obv.rolling(20).mean()) / (obv.rolling(50).std() + 1e-8)).clip(-3, 3) / 3
    d["pv_divergence"] = (-(c / c.shift(10) - 1) * (v / v.shift(10) - 1)).clip(-0.5, 0.5) * 2
    vol = (c / c.shift(1) - 1).rolling(10).std()
    d["weak_hands_score"] = (
        0.2 * (c < c.rolling(50).mean()) + 0.2 * (c < c.rolling(200).mean()) + 0.3 * ((c < o) & (v > vm * 1.5))
        + 0.2 * (vol > vol.rolling(20).mean()) + 0.1 * (o < c.shift(1) * 0.98)
    )
    low20 = lo.rolling(20).min()
    d["squeeze_potential"] = (
        0.4 * (1 - (c - low20) / (low20 + 1e-8)).clip(0, 1) + 0.3 * (v < vm * 0.7).astype(float).rolling(5).mean()
        + 0.3 * ((v > vm * 1.5) & (c > c.shift(1)))
    )
    d["smart_money_flow"] = (d.accumulation_distribution + d.smart_money_index + d.obv_trend + d.vwap_divergence) / 4
    d["retail_flow"] = -d.smart_money_flow * d.weak_hands_score
    names = [x for x in d.columns if x not in ("symbol", "time")]
    d[names] = d[names].fillna(0)
    return d


def proxy(bars, market):
    m = market.sort_values("time")
    m = pd.Series((m.close / m.close.shift(1) - 1).to_numpy(), index=m.time)

    @per_symbol
    def one(d):
        d = d.copy()
        o, h, lo, c, v = d.open, d.high, d.low, d.close, d.volume.astype(float)
        pc = c.shift(1)
        d["overnight_gap"] = (o - pc) / pc
        d["gap_reversal"] = -d.overnight_gap * (c - o) / o
        vm = v.rolling(20).mean()
        d["volume_surprise"] = (v - vm) / (vm + 1e-8)
        d["bullish_volume"], d["bearish_volume"] = d.volume_surprise * (c > o), d.volume_surprise * (c < o)
        rg = (h - lo) / o
        d["range_expansion"] = rg / rg.rolling(20).mean()
        d["fear_signal"] = d.range_expansion * (c < o)
        d["close_position"] = (c - lo) / (h - lo + 1e-8)
        r = pd.Series((c / pc - 1).to_numpy(), index=d.time)
        both = r.index.intersection(m.index)
        ex = r[both] - m[both]
        rs = (1 + r[both]).rolling(20).apply(np.prod) / (1 + m[both]).rolling(20).apply(np.prod) - 1
        d["excess_return"], d["relative_strength"] = ex.reindex(d.time).to_numpy(), rs.reindex(d.time).to_numpy()
        d["momentum_divergence"] = (c / c.shift(5) - 1) / ((v / v.shift(5) - 1).abs() + 0.01)
        d["sentiment_proxy"] = (
            0.2 * d.overnight_gap.clip(-0.1, 0.1) * 10 + 0.2 * (d.close_position * 2 - 1)
            + 0.2 * np.tanh(d.bullish_volume - d.bearish_volume) - 0.2 * np.tanh(d.fear_signal)
            + 0.2 * d.excess_return.clip(-0.05, 0.05) * 20
        )
        d["sentiment_proxy_smooth"] = d.sentiment_proxy.rolling(5).mean()
        surprise = rg / (rg.rolling(20).mean() + 1e-8)
        intensity = (
            0.4 * d.volume_surprise.abs().clip(0, 5) / 5 + 0.3 * d.overnight_gap.abs().clip(0, 0.1) / 0.1
            + 0.3 * (surprise - 1).clip(0, 3) / 3
        ).clip(0, 1)
        names = [x for x in d.columns if x not in ("symbol", "time")]
        d[names] = d[names].fillna(0)
        d["news_intensity"] = intensity
        return d

    return one(bars)


@per_symbol
def live(d):
    """Live style, row by row."""
    d = d.copy()
    c, h, lo, v = (d[x].to_numpy(dtype=float) for x in ("close", "high", "low", "volume"))
    n = len(d)
    ret = np.zeros(n)
    ret[1:] = c[1:] / c[:-1] - 1
    rsi, gain, loss = np.full(n, 50.0), 0.0, 0.0
    for i in range(1, n):
        ch = c[i] - c[i - 1]
        g, s = max(ch, 0.0), max(-ch, 0.0)
        if i <= 14:
            gain, loss = gain + g / 14, loss + s / 14
        else:
            gain, loss = (gain * 13 + g) / 14, (loss * 13 + s) / 14
        if i >= 14:
            rsi[i] = 100.0 if loss < 1e-10 else 100 - 100 / (1 + gain / loss)

    def ema(x, k):
        out = [x[0]]
        for y in x[1:]:
            out.append(out[-1] + (y - out[-1]) * 2 / (k + 1))
        return np.array(out)

    macd = ema(c, 12) - ema(c, 26)
    obv = [v[0]]
    for i in range(1, n):
        obv.append(obv[-1] + v[i] * np.sign(c[i] - c[i - 1]))
    tr = [h[0] - lo[0]] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, n)]
    d["returns"], d["rsi"], d["macd"], d["macd_signal"] = ret, rsi, macd, ema(macd, 9)
    d["atr"] = [tr[i] if i < 13 else np.mean(tr[i - 13 : i + 1]) for i in range(n)]
    d["obv_change"] = [0.0] + [(obv[i] - obv[i - 1]) / abs(obv[i - 1]) if obv[i - 1] else 0.0 for i in range(1, n)]
    d["bb_upper"] = [c[i] if i < 19 else np.mean(c[i - 19 : i + 1]) + 2 * np.std(c[i - 19 : i + 1]) for i in range(n)]
    d["volatility_10"] = [0.0 if i < 10 else np.std(ret[i - 9 : i + 1]) for i in range(n)]
    d["momentum_20"] = [0.0 if i < 20 else c[i] / c[i - 20] - 1 for i in range(n)]
    d["volume_ratio"] = [1.0 if i < 19 else v[i] / np.mean(v[i - 19 : i + 1]) for i in range(n)]
    return d
