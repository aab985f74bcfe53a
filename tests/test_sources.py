"""Files in and out, messages, pages."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from barloom.operators import universe as U
from barloom.sources import barstore as BS
from barloom.sources import landed as LD
from barloom.sources import messages as MS
from tests.helpers import random_bars, to_spark


def test_bar_store(spark, tmp_path):
    bars = random_bars(("A", "B", "market_context"), 20)
    df = to_spark(spark, bars).withColumn("tier", F.when(F.col("symbol") == "A", "blue").otherwise("mid"))
    BS.write_bars(df, str(tmp_path / "s"), by=["tier"])
    got = BS.load_bars(spark, str(tmp_path / "s"), ["A", "MISSING"])
    assert got.count() == 20 and {r.symbol for r in BS.symbols(BS.load_bars(spark, str(tmp_path / "s"))).collect()} == {"A", "B"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(symbol" in plan
    pruned = BS.load_bars(spark, str(tmp_path / "s"), tier="mid")
    assert "PartitionFilters: [isnotnull(tier" in pruned._jdf.queryExecution().executedPlan().toString()


def test_one_file_per_symbol(spark, tmp_path):
    for name in ("AAPL_day", "BRK-B_historical", "market_context"):
        random_bars(("x",), 3).to_parquet(tmp_path / f"{name}.parquet")
    assert {r.symbol for r in BS.symbols_of_files(spark, str(tmp_path)).collect()} <= {"AAPL", "BRK-B", "market"}
    assert {"AAPL", "BRK-B"} <= {r.symbol for r in BS.symbols_of_files(spark, str(tmp_path), "_(day|historical|enhanced)").collect()}


def test_pandas_written_times(spark, tmp_path):
    pdf = random_bars(("A",), 5)
    pdf["time"] = pdf["time"].astype("datetime64[ns]")
    pdf.rename(columns={"time": "Date"}).to_parquet(tmp_path / "A_day.parquet")
    got = BS.load_bars(spark, str(tmp_path)).orderBy("time").collect()
    assert [r.time for r in got] == [t.to_pydatetime() for t in pdf.time]


def test_preferred_layer(spark):
    a = to_spark(spark, random_bars(("A",), 3)).withColumnRenamed("time", "Date")
    b = to_spark(spark, random_bars(("A", "B"), 5)).withColumnRenamed("time", "timestamp")
    got = {r.symbol: r["count"] for r in BS.preferred([a, b]).groupBy("symbol").count().collect()}
    assert got == {"A": 3, "B": 5}


def test_manifest(spark, tmp_path):
    p = spark.createDataFrame([("A", "blue", True), ("B", "blue", False), ("C", "mid", False)], "symbol string, tier string, has_dividend boolean")
    BS.write_manifest(U.tier_counts(p), U.tier_symbols(p), str(tmp_path / "m"))
    counts = {r.tier: (r.n, r.dividend_payers) for r in spark.read.json(str(tmp_path / "m/counts")).collect()}
    assert counts == {"blue": (2, 1), "mid": (1, 0)}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m/symbols/tier=blue")).collect()) == ["A", "B"]


def test_listing_file(spark, tmp_path):
    f = tmp_path / "l.txt"
    f.write_text("Symbol|Name\nAAPL|x\nZtest|y\nTOOLONG|z\n|n\nFile Creation Time: 1|\n")
    assert [r.symbol for r in U.listed_symbols(LD.read_listing(spark, str(f))).collect()] == ["AAPL"]


def test_aggregates_and_daily_files(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps({"symbol": "A", "results": [{"t": 1704067200000, "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10.0}]}))
    r = LD.read_aggregates(spark, str(f)).first()
    assert r.timestamp == datetime(2024, 1, 1) and r.close == 1.5 and r.vwap is None
    thin = spark.createDataFrame([("A", 0, 1.0)], "symbol string, t bigint, c double")
    assert LD.normalize_aggregates(thin).columns == ["timestamp", "symbol", "close"]
    c = tmp_path / "d.csv"
    c.write_text("symbol,company_name,delist_reason,delist_year\nX,Ex,fraud,2001\n")
    assert LD.read_delisted_csv(spark, str(c)).first().delist_year == 2001


def test_load_delisted(spark, tmp_path):
    p = to_spark(spark, random_bars(("A",), 3)).withColumnRenamed("time", "Date")
    p.write.parquet(str(tmp_path / "p"))
    p.select("symbol", F.col("Date").alias("date"), F.lit(1).alias("delist_30d")).limit(1).write.parquet(str(tmp_path / "l"))
    got = BS.load_delisted(spark, str(tmp_path / "p"), str(tmp_path / "l"))
    assert got.count() == 3 and got.filter("delist_30d = 1").count() == 1


def test_message_edges(spark):
    rows = [
        '{"ev":"T","sym":"A","t":1704067200123456789,"p":1.5,"s":7,"c":[1,2,3,4,5]}',
        '[{"ev":"Q","sym":"A","t":1,"bp":1.0,"ap":2.0,"bs":3,"as":4},{"ev":"A","sym":"B","s":1704067200000,"o":1,"h":2,"l":0.5,"c":1.25,"v":9,"vw":1.1,"n":2}]',
        '{"ev":"T"}', '{"sym":"X"}', "garbage", "", "[]", '[{"ev":"status","message":"ok"}]', '  [ {"ev":"AM","sym":"C","s":0,"c":3} ]',
    ]
    items = MS.decode_items(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert sorted(r.ev for r in items.collect()) == ["A", "AM", "Q", "T", "T", "status"]
    t = MS.trades(items, conditions=4).filter("symbol = 'A'").first()
    assert t.ts_ns == 1704067200123456789 and t.conditions == [1, 2, 3, 4] and t.time.microsecond == 123456
    q = MS.quotes(items).first()
    assert (q.bid, q.ask, q.bid_size, q.ask_size) == (1.0, 2.0, 3, 4)
    b = {r.symbol: r for r in MS.bars(items).collect()}
    assert b["B"].close == 1.25 and b["B"].ts_ns == 1704067200000000000 and b["C"].volume is None


def test_topics_and_messages(spark, tmp_path):
    got = MS.from_topic(spark.createDataFrame([("BAR", "{}"), ("BAR", '{"symbol":"A","close":2}'), ("TRADE", "{}")], "topic string, value string"), "BAR")
    rows = sorted((r.symbol, r.close, r.volume) for r in got.collect())
    assert rows == [("", 0.0, 0), ("A", 2.0, 0)]
    s = spark.createDataFrame([("A", datetime(2024, 1, 1), 0.5, 0.1, 0.2, 0.3, 0.9, 0.05, "BUY", 95.0, 110.0, 0.01)],
                              "symbol string, time timestamp, technical_signal double, prediction_signal double, sentiment_signal double, composite_signal double, "
                              "confidence double, position_size double, action string, stop_loss double, take_profit double, expected_return double")  # fmt: skip
    body = json.loads(MS.signal_message(s).first().value)
    assert body["type"] == "signal" and body["composite"] == 0.3 and body["action"] == "BUY"
    alert = json.loads(MS.alert_message(s, F.lit("halt"), F.lit("high")).first().value)
    assert alert == {"type": "alert", "message": "halt", "severity": "high", "timestamp": 1704067200000}
    MS.append_audit(MS.audit_signals(s), str(tmp_path / "audit"))
    MS.append_audit(MS.audit_signals(s), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_page_edges(spark):
    html = (
        '<ul><li class="js stream-item"><div><a href="/a"> A long  <b>title</b> here </a><a href="/second">other link here</a></div></li>'
        '<li class="other"><a href="/no">not a news item</a></li><li class="stream-item-x"><a href="http://e.x/b">Another title</a></li>'
        '<li class="stream-item"><a href="/s">short</a></li><li class="stream-item">no link at all</li></ul>'
    )
    df = spark.createDataFrame([(1, html), (2, None), (3, "<li class='stream-item'><a href='/c'>unclosed title")], "id int, html string")
    got = sorted((r.id, r.title, r.url) for r in LD.page_links(df, "https://s").collect())
    assert got == [(1, "A longtitlehere", "https://s/a"), (1, "Another title", "http://e.x/b"), (3, "unclosed title", "https://s/c")]
    table = '<table class="x"><tr><td>Today</td><td><a href="/q">no</a></td></tr></table><table class="fullview-news-outer">' + "".join(
        f'<tr><td>Jan-0{1 + i % 9}-24 08:00AM</td><td><a href="/{i}">t{i}</a></td></tr>' for i in range(25)
    )
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    rows = LD.page_news_rows(spark.createDataFrame([(1, table)], "id int, html string"), now, k=20).collect()
    assert len(rows) == 20 and rows[0].published == datetime(2024, 1, 1) and rows[0].title == "t0"


def test_layers_follow_their_files(spark, tmp_path):
    from barloom.sources.stage import exists, layer

    folder = str(tmp_path / "in")
    build = lambda: spark.read.parquet(folder).withColumn("twice", F.col("id") * 2)
    spark.range(5).write.parquet(folder)
    assert layer(spark, "twice", folder, build).count() == 5
    first = layer(spark, "twice", folder, build).inputFiles()
    assert layer(spark, "twice", folder, build).inputFiles() == first
    spark.range(7).write.mode("append").parquet(folder)
    assert layer(spark, "twice", folder, build).count() == 12
    assert exists(spark, folder) and not exists(spark, folder + "-not")


def test_reading_files_leaves_the_session_as_it_is(spark, tmp_path):
    option = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(option)
    spark.range(1).write.parquet(str(tmp_path / "x"))
    BS.read_files(spark, str(tmp_path / "x")).count()
    assert spark.conf.get(option) == before
