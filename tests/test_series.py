"""Blocks give what one window per symbol gives, whatever the block size and the skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.series import Series, ewm_term, number_rows, span_term
from tests.helpers import random_bars, same, to_spark


@pytest.fixture(scope="module")
def skewed():
    """One symbol has most of the rows; another has one."""
    a = random_bars(("HOT",), 700, seed=1)
    b = random_bars(("B", "C"), 60, seed=2)
    c = random_bars(("ONE",), 1, seed=3)
    return pd.concat([a, b, c], ignore_index=True)


@pytest.mark.parametrize("chunk", ["month", "year", "day"])
def test_number_rows(spark, skewed, chunk):
    got = number_rows(to_spark(spark, skewed), chunk=chunk).toPandas().sort_values(["symbol", "time"])
    want = got.groupby("symbol").cumcount()
    assert (got["_t"] == want).all()
    assert len(got) == len(skewed)


def test_number_rows_of_a_whole_table(spark, skewed):
    df = to_spark(spark, skewed).select("time").distinct()
    got = number_rows(df, key=(), chunk="year").toPandas().sort_values("time")
    assert list(got["_t"]) == list(range(len(got)))


@pytest.mark.parametrize("size", [16, 64, 1024])
def test_trailing_windows(spark, skewed, size):
    s = Series.of(to_spark(spark, skewed), behind=60, ahead=7, size=size)
    s = s.long_mean({"m50": ("close", 50)}).with_columns(
        m=s.mean("close", 20), sd=s.std("close", 60), lag3=s.back("close", 3), lead7=s.ahead("close", 7),
        hi=s.roll(F.max, "high", 5),
    )
    got = s.own().toPandas()
    w = skewed.sort_values(["symbol", "time"]).copy()
    g = w.groupby("symbol").close
    w["m"] = g.transform(lambda x: x.rolling(20).mean())
    w["m50"] = g.transform(lambda x: x.rolling(50).mean())
    w["sd"] = g.transform(lambda x: x.rolling(60).std())
    w["lag3"], w["lead7"] = g.shift(3), g.shift(-7)
    w["hi"] = w.groupby("symbol").high.transform(lambda x: x.rolling(5).max())
    same(got, w, ["m", "m50", "sd", "lag3", "lead7", "hi"])


@pytest.mark.parametrize("size", [32, 128, 1024])
def test_recursive_averages_and_totals(spark, skewed, size):
    s = Series.of(to_spark(spark, skewed), behind=0, size=size)
    s = s.accumulate(
        {
            "e5": span_term("close", 5),
            "e200": span_term("close", 200),
            "w14": ewm_term("close", 1 / 14, start=3),
            "total": (F.col("close"), 1.0),
        }
    )
    got = s.own().toPandas()
    w = skewed.sort_values(["symbol", "time"]).copy()
    g = w.groupby("symbol").close
    w["e5"] = g.transform(lambda x: x.ewm(span=5, adjust=False).mean())
    w["e200"] = g.transform(lambda x: x.ewm(span=200, adjust=False).mean())
    w["total"] = g.cumsum()
    same(got, w, ["e5", "e200", "total"], rtol=1e-12)
    late = w.groupby("symbol").close.transform(lambda x: x.iloc[3:].ewm(alpha=1 / 14, adjust=False).mean())
    g2 = got.sort_values(["symbol", "time"]).reset_index(drop=True)
    known = ~late.isna().to_numpy()
    np.testing.assert_allclose(g2.w14.to_numpy()[known], late.to_numpy()[known], rtol=1e-12)


def test_overflowing_block_is_refused(spark, skewed):
    s = Series.of(to_spark(spark, skewed), behind=0, size=1024)
    with pytest.raises(ValueError, match="overflows"):
        s.accumulate({"e": span_term("close", 2)})


def test_running_max(spark, skewed):
    got = Series.of(to_spark(spark, skewed), behind=0, size=32).running_max("top", "high").own().toPandas()
    w = skewed.copy().sort_values(["symbol", "time"])
    w["top"] = w.groupby("symbol").high.cummax()
    same(got, w, ["top"])


def test_no_task_gets_more_than_a_block(spark, skewed):
    s = Series.of(to_spark(spark, skewed), behind=20, size=64)
    biggest = s.df.groupBy("symbol", "_blk").count().agg(F.max("count")).first()[0]
    assert biggest <= 64 + 20


def test_numbered_frames_stay_numbered(spark, skewed):
    numbered = number_rows(to_spark(spark, skewed))
    out = Series.of(numbered, behind=3).own()
    assert "_t" in out.columns and out.count() == len(skewed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") == 1
