"""A materialised aggregate under its policy, and outputs at several cadences."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators.bars import bars_from_ticks
from barloom.streaming import refresh as R
from tests.test_streaming import SCHEMA, START, land, source, tick, where  # noqa: F401

H = timedelta(hours=1)


def aggregate(spark, path):
    return R.ContinuousAggregate(spark, path, lambda t: bars_from_ticks(t, "1h").select("symbol", "time", "open", "close", "trade_count"))


def counts(df):
    return {(r.symbol, (r.time - START) // H): r.trade_count for r in df.collect()}


def test_regions():
    p = R.Policy()
    at = datetime(2024, 1, 1, 12)
    assert p.region(at, at, H) == (at - 3 * H, at - H)
    assert p.region(at + timedelta(minutes=10), at + timedelta(minutes=10), H) == (at - 2 * H, at - H)  # whole buckets only
    assert p.region(at, at + 2 * H, H) == (at - 3 * H, at + H)


def test_late_rows_inside_and_outside_the_region(spark, tmp_path):
    """Two refreshes: late rows count where a region holds them, and in the head at once."""
    agg = aggregate(spark, str(tmp_path / "agg"))
    first = [tick(60 * h + 5, h, 100 + h) for h in range(0, 30)]
    rows = spark.createDataFrame(first, SCHEMA)
    assert counts(agg.read(rows)) == {("A", h): 1 for h in range(30)} and agg.until() is None
    agg.rebuild(rows, None, START + 28 * H)
    assert agg.until() == START + 28 * H
    late = [tick(60 * h + 1, 100 + h, 50) for h in (2, 27, 28, 29)] + [tick(60 * 30 + 1, 200, 7)]
    rows = spark.createDataFrame(first + late, SCHEMA)
    before = counts(agg.read(rows))
    assert [before["A", h] for h in (2, 27, 28, 29, 30)] == [1, 1, 2, 2, 1]  # the head is read from the ticks
    reader = agg.materialised()
    agg.refresh(rows, START + 30 * H)
    after = counts(agg.read(rows))
    assert [after["A", h] for h in (2, 26, 27, 28, 29, 30)] == [1, 1, 2, 2, 2, 1] and len(after) == 31
    assert counts(reader) == {("A", h): 1 for h in range(28)}  # a reader from before still finds its files
    agg.refresh(rows, START + 30 * H)  # again: nothing changes
    assert counts(agg.read(rows)) == after and counts(agg.materialised()) == {k: v for k, v in after.items() if k[1] < 29}


def test_many_refreshes_keep_one_folder_per_day(spark, tmp_path):
    agg = aggregate(spark, str(tmp_path / "agg"))
    rows = spark.createDataFrame([tick(60 * h + 5, h, 100) for h in range(60)], SCHEMA)
    agg.rebuild(rows, None, START + 20 * H)
    for h in range(22, 34, 2):
        agg.refresh(rows, START + h * H)
    assert len(agg.materialised().inputFiles()) <= 3 * 4 and len(agg.runs()) == 2
    assert max(len(v) for v in agg._versions().values()) <= 2
    assert counts(agg.read(rows)) == {("A", h): 1 for h in range(60)}


def test_stream_refreshes_when_due(spark, where):  # noqa: F811
    folder, out, checkpoint = where
    agg = aggregate(spark, f"{out}/agg")
    batches = [
        [tick(60 * h + 5, h, 100) for h in range(6)],  # seen until 5:05: all before 4:00 is materialised
        [tick(30, 100, 9), tick(60 * 5 + 30, 101, 9)],  # late beyond the region, and no new instant
        [tick(60 * 3 + 30, 102, 9), tick(60 * 6 + 1, 103, 9)],  # 6:00 is due: [3:00, 5:00) is rebuilt
        [tick(60 * 4 + 30, 104, 9), tick(60 * 8 + 1, 105, 9)],  # 7:00 and 8:00 are due: [4:00, 7:00)
    ]
    for i, rows in enumerate(batches):
        land(spark, folder, str(i), rows)
        R.keep_refreshed(source(spark, folder), agg, out, checkpoint)
        if i == 1:
            assert agg.until() == START + 4 * H and counts(agg.read(R.stored(spark, out)))["A", 0] == 1
    assert agg.until() == START + 7 * H
    assert counts(agg.read(R.stored(spark, out))) == {("A", 0): 1, ("A", 1): 1, ("A", 2): 1, ("A", 3): 2, ("A", 4): 2, ("A", 5): 2, ("A", 6): 1, ("A", 8): 1}


def test_cadences(spark, where):  # noqa: F811
    folder, out, checkpoint = where
    day = 24 * 60
    one = [tick(day - 30, 1, 100, "A"), tick(day - 29, 2, 100, "B", 0)]
    two = [tick(day + 1, 3, 100, "A"), tick(day + 2.5, 4, 110, "A"), tick(day + 3, 5, 50, "B"), tick(day + 4, 6, 10, "C")]
    three = [tick(day + 16, 7, 10, "A"), tick(day + 21, 8, 10, "A")]
    handlers = R.screening(spark, out, news=F.col("seq") == 5, tone=F.lit(0.5))
    for i, rows in enumerate((one, two, three)):
        land(spark, folder, str(i), rows)
        R.cadenced(source(spark, folder), handlers, out, checkpoint)
    due = {(r.output, (r.due_at - START) // timedelta(minutes=1)) for r in R.due_table(spark, out).collect()}
    minutes = lambda step: {m for m in range(day - 29, day + 22) if m % step == 0}
    assert due == {(n, m) for n, s in (("factors", 1), ("rankings", 5), ("sentiment", 15), ("universe", day)) for m in minutes(s)}
    ranks = {((r.refreshed_at - START) // timedelta(minutes=1), r.symbol): round(r.score, 6) for r in R.output(spark, out, "rankings").collect()}
    assert ranks == {(day + 5, "A"): 0.1, (day + 20, "A"): 0.0}  # B had no volume and C no day before
    assert [(r.symbol, r.sentiment) for r in R.output(spark, out, "sentiment").collect()] == [("B", 0.5)]
