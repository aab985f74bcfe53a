"""Generations of revisions: bounded reads, repeated and broken-off batches, snapshots."""

from pyspark.sql import functions as F

from barloom.sources.keyed_store import KeyedStore, Snapshots
from barloom.streaming import jobs as J
from tests.test_streaming import SCHEMA, land, source, tick, where  # noqa: F401


def rows(spark, batch):
    return spark.range(4).select(F.concat(F.lit("k"), F.when(F.col("id") < 3, (F.col("id") + batch) % 6)).alias("key"), F.lit(batch).alias("value"))


def test_fifty_batches_read_as_few_folders(spark, tmp_path):
    store, want, most = KeyedStore(spark, str(tmp_path / "s"), ["key"], every=4), {}, 0
    assert store.read() is None
    for batch in range(50):
        store.write(rows(spark, batch), batch)
        want |= {f"k{(i + batch) % 6}": batch for i in range(3)} | {None: batch}
        most = max(most, len(store.parts()))
        on_disk = len(store.folder.names("revisions")) + len(store.folder.names("generations"))
        assert on_disk <= 2 + 2 * 4
        if batch % 12 == 5:
            assert {r.key: r.value for r in store.read().collect()} == want
    assert {r.key: r.value for r in store.read().collect()} == want and most <= 1 + 4


def test_repeated_and_broken_off_batches(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path / "s"), ["key"], every=3)
    for batch in range(7):
        store.write(rows(spark, batch), batch)
        store.write(rows(spark, batch), batch)
    want = sorted(map(str, store.read().collect()))
    store.write(rows(spark, 100), 1)  # long since merged: a replay does not come back
    assert sorted(map(str, store.read().collect())) == want
    reader = store.read()  # planned before the next two generations
    monkeypatch.setattr(store.folder, "mark", lambda name: 1 / 0)
    for batch in (7, 8):
        try:
            store.write(rows(spark, batch), batch)
        except ZeroDivisionError:
            pass
    assert sorted(map(str, reader.collect())) == want
    fresh = KeyedStore(spark, str(tmp_path / "s"), ["key"], every=3)
    fresh.write(rows(spark, 8), 8)
    fresh.write(rows(spark, 9), 9)
    assert max(r.value for r in fresh.read().collect()) == 9 and sorted(map(str, reader.collect())) == want


def test_snapshots_keep_two(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "s"))
    assert snaps.read() is None and snaps.before(0, "id long").count() == 0
    for batch in range(5):
        snaps.write(snaps.before(batch, "id long").union(spark.range(batch, batch + 1)), batch)
        snaps.write(snaps.before(batch, "id long").union(spark.range(batch, batch + 1)), batch)
    assert sorted(r.id for r in snaps.read().collect()) == [0, 1, 2, 3, 4]
    assert snaps.folder.names() == ["batch=3", "batch=4"]


def test_a_stream_over_many_batches(spark, where):  # noqa: F811
    folder, out, checkpoint = where
    for i in range(9):
        land(spark, folder, str(i), [tick(i * 20, i, 100 + i), tick(3, 100 + i, 50, symbol="B")])
    J.revisions(J.bars(source(spark, folder)), out, checkpoint, ["symbol", "time"], merge=3)
    got = {(r.symbol, r.time.hour): r.trade_count for r in J.newest(spark, out, ["symbol", "time"]).collect()}
    assert got == {("A", 0): 3, ("A", 1): 3, ("A", 2): 3, ("B", 0): 9}
    assert len(KeyedStore(spark, out, ["symbol", "time"]).parts()) <= 4


def test_one_symbol_holds_all_bars_of_a_day(spark, where):  # noqa: F811
    """A hot symbol-day is cut into runs; state folders do not add up."""
    folder, out, checkpoint = where
    schema = "symbol string, time timestamp_ntz, seq bigint, close double"
    for i in range(4):
        land(spark, folder, str(i), [(*tick(0, 50 * i + j, 0)[:1], tick(50 * i + j, 0, 0)[1], 50 * i + j, float(j)) for j in range(50)], schema)
    J.score_histories(source(spark, folder, schema), lambda: lambda h: float(h.close.sum()), out, checkpoint, keep=8, ready=3)
    got = {r.seq: (r.n_bars, r.score) for r in J.scores(spark, out).collect()}
    close = [float(j) for _ in range(4) for j in range(50)]
    assert got == {i: (min(8, i + 1), sum(close[max(0, i - 7) : i + 1]) if i >= 2 else None) for i in range(200)}
    assert len(Snapshots(spark, f"{out}/kept").folder.names()) == 2
