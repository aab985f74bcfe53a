"""Streams equal their batch forms; late rows, repeated batches and state over several batches."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.bars import bars_from_ticks
from barloom.plans.catalog import QUERIES
from barloom.sources.keyed_store import Folder
from barloom.streaming import delivery as D
from barloom.streaming import jobs as J

SCHEMA = "symbol string, time timestamp_ntz, seq bigint, price double, size bigint"
START = datetime(2024, 1, 1)


def land(spark, folder, name, rows, schema=SCHEMA):
    """One file per call, read in name order one per micro-batch."""
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


def source(spark, folder, schema=SCHEMA):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(str(folder))


@pytest.fixture
def where(tmp_path):
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")


def tick(minutes, seq, price, symbol="A", size=10):
    return (symbol, START + timedelta(minutes=minutes), seq, float(price), size)


def test_bars_do_not_depend_on_the_cut_into_batches(spark, where):
    folder, out, checkpoint = where
    ticks = [tick(i, i, 100 + i % 7) for i in (600, 5, 300, 1, 900)]
    for i, t in enumerate(ticks):
        land(spark, folder, str(i), [t])
        J.revisions(J.bars(source(spark, folder)), out, checkpoint)
    got = J.newest(spark, out, ["symbol", "time"]).toPandas().sort_values("time").reset_index(drop=True)
    want = bars_from_ticks(spark.createDataFrame(ticks, SCHEMA), "1h").toPandas().sort_values("time").reset_index(drop=True)
    cols = ["symbol", "time", "open", "high", "low", "close", "volume", "trade_count"]
    pd.testing.assert_frame_equal(got[cols], want[cols], check_dtype=False)


def test_bars_over_batches_with_late_rows(spark, where):
    folder, out, checkpoint = where
    first = [tick(i, i, 100 + i % 7) for i in range(0, 600, 3)]
    land(spark, folder, "1", first)
    stream = lambda: J.bars(source(spark, folder), late=J.LATE)
    J.revisions(stream(), out, checkpoint)
    near, far = tick(560, 9001, 500), tick(5, 9002, 999)
    land(spark, folder, "2", [near, far, tick(650, 9003, 101)])
    J.revisions(stream(), out, checkpoint)
    got = J.newest(spark, out, ["symbol", "time"]).toPandas().sort_values("time").reset_index(drop=True)
    kept = spark.createDataFrame([*first, near, tick(650, 9003, 101)], SCHEMA)
    want = bars_from_ticks(kept, "1h").toPandas().sort_values("time").reset_index(drop=True)
    cols = ["symbol", "time", "open", "high", "low", "close", "volume", "trade_count"]
    pd.testing.assert_frame_equal(got[cols], want[cols], check_dtype=False)
    assert got.high.max() == 500  # the late row inside the allowance revised its bar, the older one did not


def test_restart_repeats_nothing(spark, where):
    folder, out, checkpoint = where
    land(spark, folder, "1", [tick(i, i, 100) for i in range(10)])
    for _ in range(2):
        J.revisions(J.bars(source(spark, folder)), out, checkpoint)
    assert J.newest(spark, out, ["symbol", "time"]).first().trade_count == 10


def test_rollup_and_sliding(spark, where):
    folder, out, checkpoint = where
    rows = [tick(i, i, 100 + i) for i in range(0, 180)]
    land(spark, folder, "1", rows)
    t = source(spark, folder)
    p = F.col("price")
    small = t.select("symbol", "time", p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"),
                     F.col("size").alias("volume"), F.lit(1).alias("trade_count"), p.alias("vwap"))
    J.revisions(J.coarser_bars(small), out, checkpoint)
    got = J.newest(spark, out, ["symbol", "time"]).orderBy("time").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(100, 159, 600), (160, 219, 600), (220, 279, 600)]
    s = J.sliding_factors(source(spark, folder), late="10 minutes")
    J.revisions(s, out + "2", checkpoint + "2")
    at = J.newest(spark, out + "2", ["symbol", "time"]).filter(F.col("time") == START + timedelta(minutes=10)).first()
    assert at.n == 5 and at.avg_price == 112.0


def test_history_over_batches_with_a_late_bar(spark, where):
    folder, out, checkpoint = where
    schema = "symbol string, time timestamp_ntz, seq bigint, close double"
    row = lambda i, x: ("A", START + timedelta(minutes=i), i, float(x))
    land(spark, folder, "1", [row(i, i) for i in (0, 1, 3)], schema)
    land(spark, folder, "2", [row(2, 2), row(4, 4)], schema)
    rate = lambda: lambda h: float((h.close * range(len(h))).sum())
    J.score_histories(source(spark, folder, schema), rate, out, checkpoint, keep=4, ready=3)
    land(spark, folder, "3", [row(0, 50), row(5, 5)], schema)  # the first is older than the full history
    J.score_histories(source(spark, folder, schema), rate, out, checkpoint, keep=4, ready=3)
    got = {(r.seq, r.n_bars, r.score) for r in J.scores(spark, out).collect()}
    assert got == {
        (0, 1, None), (1, 2, None), (3, 3, 0 * 0 + 1 * 1 + 3 * 2), (2, 3, 0 * 0 + 1 * 1 + 2 * 2),
        (4, 4, 1 * 0 + 2 * 1 + 3 * 2 + 4 * 3), (5, 4, 2 * 0 + 3 * 1 + 4 * 2 + 5 * 3),
    }


def test_latest_quote_and_last_trades(spark, where):
    folder, out, checkpoint = where
    land(spark, folder, "1", [tick(i, i, i) for i in range(8)])
    land(spark, folder, "2", [tick(3, 100, 33), tick(9, 9, 9, symbol="B")])
    q = source(spark, folder).select("symbol", "time", "seq", F.col("price").alias("bid"), F.col("price").alias("ask"))
    J.revisions(J.latest_quotes(q), out, checkpoint)
    assert {(r.symbol, r.bid) for r in J.newest(spark, out, ["symbol"]).collect()} == {("A", 7.0), ("B", 9.0)}
    J.last_trades(source(spark, folder), out + "2", checkpoint + "2", 6)
    got = J.newest_trades(spark, out + "2", 6).filter("symbol = 'A'").orderBy("age").collect()
    assert [r.price for r in got] == [7.0, 6.0, 5.0, 4.0, 33.0, 3.0]


def test_halts_over_batches(spark, where):
    folder, out, checkpoint = where
    schema = "symbol string, time timestamp_ntz, seq bigint, ok boolean"
    row = lambda s, ok: ("A", START + timedelta(seconds=s), s, ok)
    land(spark, folder, "1", [row(i, i == 2) for i in range(5)], schema)  # four failures, a success in between
    land(spark, folder, "2", [row(10, False), row(20, True), row(310, True), row(311, False), row(700, True), row(701, False)], schema)
    J.halt_intervals(J.event_time(source(spark, folder, schema)), out, checkpoint)
    got = [(r.seq, r.state, r.failures) for r in J.halts(spark, out).orderBy("seq", "failures", F.desc("state")).collect()]
    # the fifth failure halts; 310 is not yet past the cool-down, 311 is and fails, 700 succeeds
    assert got == [(10, "OPEN", 5), (311, "HALF_OPEN", 5), (311, "OPEN", 6), (700, "CLOSED", 0), (700, "HALF_OPEN", 6)] or got == [
        (10, "OPEN", 5), (311, "HALF_OPEN", 5), (311, "OPEN", 6), (700, "HALF_OPEN", 6), (700, "CLOSED", 0)
    ]


def test_dispatch_and_articles(spark, where, tmp_path):
    folder, out, checkpoint = where
    schema = "value string"
    land(spark, folder, "1", [('{"ev":"T","sym":"A","t":1,"p":1.0,"s":2}',), ("broken",)], schema)
    land(spark, folder, "2", [('[{"ev":"T","sym":"B","t":1,"p":1.0,"s":3},{"ev":"Q","sym":"B","t":1}]',)], schema)
    seen = {"trade": [], "quote": []}
    handlers = {k: (lambda k: lambda df, i: seen[k].extend(r.symbol for r in df.collect()))(k) for k in seen}
    J.dispatch(source(spark, folder, schema), handlers, checkpoint)
    assert sorted(seen["trade"]) == ["A", "B"] and seen["quote"] == ["B"]

    docs = "article_id bigint, text string"
    land(spark, tmp_path / "docs", "1", [(1, "up"), (2, "down")], docs)
    land(spark, tmp_path / "docs", "2", [(1, "down")], docs)
    published = []
    score = lambda df: df.withColumn("sentiment", F.when(F.col("text") == "up", 1.0).otherwise(-1.0))
    J.articles(source(spark, tmp_path / "docs", docs), F.array(F.lit("A"), F.lit("A"), F.lit("B")), score, out, checkpoint + "d",
               publish=lambda df, i: published.append(df.count()))
    got = {(r.article_id, r.symbol): r.sentiment for r in J.newest(spark, out, ["article_id", "symbol"]).collect()}
    assert got == {(1, "A"): -1.0, (1, "B"): -1.0, (2, "A"): -1.0, (2, "B"): -1.0} and published == [4, 2]


@pytest.mark.parametrize("kind", ["file", "folder", "partitions"])
def test_streams_read_tables_of_one_file_or_many(spark, tmp_path, kind):
    docs = [(0, "x" * 14, "en"), (1, "x" * 20, "de"), (2, "x" * 13, "en"), (3, "x" * 2, "de"), (4, "\u00e9" * 30, "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    if kind == "file":
        df.toPandas().to_parquet(tmp_path / "documents.parquet")
    else:
        writer = df.repartition(3).write
        (writer.partitionBy("lang") if kind == "partitions" else writer).parquet(str(tmp_path / "documents.parquet"))
    df.toPandas().to_parquet(tmp_path / "other_documents.parquet")
    got = sorted((r.article_id, r.symbol, r.sentiment) for r in QUERIES["stream_articles"](spark, str(tmp_path)).collect())
    assert got == [(0, "A", -0.1), (1, "A", 0.5), (1, "B", 0.5), (2, "C", None), (3, "A", -1.0), (4, "A", 1.0), (4, "B", 1.0)]


def test_messages_are_delivered_once(spark, where, tmp_path):
    """Repeated batches, a job that ends between sending and noting, and equal messages that are meant twice."""
    folder, _, checkpoint = where
    schema = "key string, value string, topic string"
    batches = [[("a", "1", "X"), ("a", "1", "X"), ("a", "1", "Y"), (None, "2", "Y")], [("a", "1", "X"), ("b", None, "X"), ("c", "3", "Z")]]
    for i, rows in enumerate(batches):
        land(spark, folder, str(i), rows, schema)
    path = str(tmp_path / "topics")
    publisher = D.Publisher(str(tmp_path / "ledger"), "json", {"path": path}, ["X", "Y"])
    D.publish(source(spark, folder, schema), publisher, checkpoint)
    want = sorted(str(r) for rows in batches for r in rows if r[2] in "XY")
    got = lambda: sorted(str((r.key, r.value, r.topic)) for r in D.sent_files(spark, path, "json").collect())
    assert got() == want and publisher.delivered(spark) == {("X", 0), ("X", 1), ("Y", 0), ("Y", 1)}
    again = spark.createDataFrame(batches[0], schema)
    publisher(again, 0)
    assert spark.read.json(path).count() == len(want)  # not sent again
    Folder(spark, publisher.ledger).drop("delivered/Y-0")
    publisher(again.repartition(3), 0)  # Y had been sent, but not noted
    assert spark.read.json(path).count() == len(want) + 2 and got() == want
