"""Articles, knowledge-graph records and text scoring."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import news as N
from barloom.operators import scoring as SC
from barloom.sources import graph_records as G


def test_hash(spark):
    import hashlib

    r = spark.createDataFrame([("Title é", "http://x")], "title string, url string")
    want = hashlib.md5("Title éhttp://x".encode()).hexdigest()[:16]
    assert N.with_hash(r).first().hash == want


def test_first_source_wins_and_hot_copies_collapse(spark):
    a = spark.range(500).select(F.lit("same").alias("title"), F.lit("u").alias("url"), F.col("id").alias("article_id"))
    b = a.withColumn("article_id", -F.col("article_id") - 1)
    got = N.dedupe_articles(N.fan_in(a, b)).collect()
    assert len(got) == 1 and got[0].article_id == 0 and got[0].source_rank == 0


def test_upsert_and_anti_join(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert {(r.k, r.v) for r in N.upsert(base, delta, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert [r.k for r in N.new_only(delta, base, "k").collect()] == [3]


@pytest.mark.parametrize(
    "reply,want",
    [
        ('x {"sentiment_score": 2, "confidence": -1, "reasoning": "r"} y', (1.0, 0.0, "r")),
        ('{"confidence": 0.9}', (0.0, 0.9, "")),
        ('{"sentiment_score": -0.25}', (-0.25, 0.5, "")),
        ("nothing", (None, None, None)),
        ('{"sentiment_score": oops}', (None, None, None)),
        ('line\n{\n"sentiment_score": 0.5\n}', (0.5, 0.5, "")),
        (None, (None, None, None)),
    ],
)
def test_reply(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string").withColumns(N.parse_reply(F.col("reply")))
    r = df.first()
    assert (r.sentiment, r.confidence, r.reasoning) == want


def test_daily_sentiment_edges(spark):
    t = datetime(2024, 1, 1, 5)
    rows = [("A", t, "x", 0.5), ("A", t, "x", None), ("B", t, "x", 0.5), ("B", t, "y", -0.5), ("B", t, "y", 0.1), ("C", t, "z", None)]
    got = N.daily_sentiment(spark.createDataFrame(rows, "symbol string, published timestamp_ntz, source string, sentiment double"))
    d = {r.symbol: r for r in got.collect()}
    assert set(d) == {"A", "B"} and d["A"].sentiment_std == 0.0 and d["A"].article_count == 1
    np.testing.assert_allclose(d["B"].sentiment_std, np.std([0.5, -0.5, 0.1]))
    assert d["B"].source_breakdown.keys() == {"x", "y"} and abs(d["B"].source_breakdown["y"] + 0.2) < 1e-12


def test_decayed_sentiment_on_an_hourly_grid(spark):
    rng = np.random.default_rng(2)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        at = start + timedelta(minutes=int(rng.integers(0, 3000)))
        rows.append((i, "HOT", at, f"t{i}", ["reuters", "blog"][i % 2], float(rng.uniform(-1, 1)), float(rng.uniform(0.1, 1))))
    df = spark.createDataFrame(
        rows, "article_id long, symbol string, published timestamp_ntz, title string, source string, sentiment double, confidence double"
    )
    got = {r.time: r for r in N.decayed_sentiment(df, step_hours=1, lookback_hours=24, trail=3).collect()}
    for hour in range(0, 80):
        at = start + timedelta(hours=hour)
        live = [r for r in rows if timedelta(0) <= at - r[2] < timedelta(hours=24)]
        if not live:
            assert at not in got
            continue
        w = [math.exp(-(at - r[2]).total_seconds() / 21600) * (1.0 if r[4] == "reuters" else 0.5) * r[6] for r in live]
        want = sum(r[5] * x for r, x in zip(live, w)) / sum(w)
        assert got[at].article_count == len(live) and abs(got[at].weighted_sentiment - want) < 1e-12
        top = max(zip(live, w), key=lambda p: abs(p[0][5] * p[1]))[0][3]
        assert got[at].top_headline == top


def line(date="20240102093000", tone="1.5,2,3,4,321,6", themes="ECON_X;B", orgs="Apple Inc;Google", n=27):
    f = [""] * n
    f[0], f[1], f[3], f[4], f[7], f[9], f[11], f[13], f[15] = "id", date, "src", "http://u", themes, "L1;L2", "Ann;;BOB", orgs, tone
    return "\t".join(f)


def test_graph_file(spark, tmp_path):
    lines = [line(), line(date="2024bad"), line(tone="n/a"), line(tone="1,2,3,4,x"), line(tone="-2.25"), line(tone=""), line(n=27) + "\textra",
             line(themes="", orgs=""), "short\t20240103"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = G.read_graph_records(spark, str(tmp_path / "a.csv")).collect()
    assert len(got) == 5
    assert sorted((r.tone is None, r.tone or 0, r.word_count) for r in got) == [
        (False, -2.25, 0), (False, 1.5, 321), (False, 1.5, 321), (True, 0, 0), (True, 0, 0)
    ]
    full = [r for r in got if r.word_count == 321 and r.themes][0]
    assert full.themes == ["ECON_X", "B"] and full.persons == ["ann", "bob"] and full.organizations == ["apple inc", "google"]
    assert full.locations == ["L1", "L2"] and str(full.date) == "2024-01-02"


def test_relevance_and_mentions(spark):
    df = spark.createDataFrame(
        [(1, line(themes="econ_stock")), (2, line(themes="sport", orgs="Tesla ;tesla inc;Apple")), (3, line(themes="", orgs="nobody"))],
        "id int, value string",
    )
    r = G.parse_lines(df)
    assert [x.id for x in G.market_relevant(r).collect()] == [1]
    assert sorted(x.id for x in G.market_relevant(r, ["TSLA"]).collect()) == [1, 2]
    assert sorted(x.id for x in G.market_relevant(r, ["NFLX"]).collect()) == [1]
    assert sorted((x.id, x.ticker) for x in G.mentions(r).collect()) == [(1, "AAPL"), (1, "GOOGL"), (2, "AAPL"), (2, "TSLA")]
    assert [x.ticker for x in G.mentions(r, {"nobody": "NB"}).filter("id = 3").collect()] == ["NB"]


def test_score_scale(spark):
    df = spark.createDataFrame([("A", 20.0), ("A", -5.0)], "ticker string, tone double").withColumn("date", F.lit("2024-01-01").cast("date"))
    raw = N.ticker_sentiment(df).first()
    scaled = N.ticker_sentiment(df, scale=100.0).first()
    assert (raw.bullish_ratio, raw.bearish_ratio) == (0.5, 0.5)
    assert (scaled.bullish_ratio, scaled.bearish_ratio) == (0.5, 0.0)


def test_scorer_concurrency_and_models(spark):
    docs = spark.range(20).select(F.col("id").cast("string").alias("text"))

    def make():
        return lambda xs: [f'{{"sentiment_score": {int(x) / 100}}}' for x in xs]

    out = SC.score_texts(docs, make, max_concurrent=3)
    assert out.count() == 20 and abs(out.agg(F.sum("sentiment")).first()[0] - 1.9) < 1e-12
    df = spark.range(200).select((F.col("id") / 200).alias("x"), (F.col("id") / 100).alias("y"), (F.col("id") % 5 == 0).alias("val"))
    model = SC.fit_return_model(df, ["x"], "y", validation="val", kind="trees")
    got = SC.predict_return(model, df, ["x"])
    assert got.select(F.max(F.abs(F.col("predicted_return") - F.col("y")))).first()[0] < 0.2
    s = df.limit(1).withColumns(SC.prediction_signal(F.lit(-0.5))).first()
    assert (s.direction, s.signal, s.confidence) == (-1, "SELL", 1.0)
