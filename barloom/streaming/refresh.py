"""Results that are refreshed on a schedule: a materialised aggregate with a policy, and outputs at several cadences.

Schedules run on event time: an instant is due once an event at or after it has been seen. Instants that
one micro-batch passes see the same data, so what they refresh is made together, by one job.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.keyed_store import Folder, KeyedStore, Snapshots
from barloom.streaming.jobs import _start

# The hourly bars are rebuilt from 3 hours to 1 hour ago, every hour.
REFRESH = {"start": timedelta(hours=3), "end": timedelta(hours=1), "every": timedelta(hours=1)}

# Refresh cadences of the screening steps, in the order in which they read each other.
CADENCES = {"universe": timedelta(days=1), "sentiment": timedelta(minutes=15), "factors": timedelta(minutes=1), "rankings": timedelta(minutes=5)}

ZERO = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)


def floor_to(t: datetime, step: timedelta) -> datetime:
    """The last instant of a schedule that is not after ``t``."""
    return t - (t - ZERO) % step


def at(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def _newest_time(rows: DataFrame) -> tuple[datetime | None, datetime | None]:
    """First and last time of some rows."""
    t = F.unix_micros(F.col("time").cast("timestamp_ntz").cast("timestamp"))
    zero = F.unix_micros(at(ZERO).cast("timestamp"))
    low, high = rows.agg(F.min(t - zero), F.max(t - zero)).first()
    return (None, None) if low is None else (ZERO + low * MICRO, ZERO + high * MICRO)


class Policy(NamedTuple):
    """A refresh at ``now`` rebuilds the whole buckets in [now - start, now - end)."""

    start: timedelta = REFRESH["start"]
    end: timedelta = REFRESH["end"]
    every: timedelta = REFRESH["every"]

    def region(self, first: datetime, last: datetime, bucket: timedelta) -> tuple[datetime, datetime]:
        """What the refreshes from the instant ``first`` to ``last`` rebuild."""
        low = first - self.start
        return floor_to(low + bucket - MICRO, bucket), floor_to(last - self.end, bucket)


class ContinuousAggregate:
    """Buckets of an aggregate as files. Days are rebuilt in new folders, which a pointer shows all at once.

    ``build`` turns source rows into rows with a bucket ``time``; a bucket depends on the source rows in it alone, and
    the source is only added to. A materialised bucket changes only when a refresh rebuilds it. The open head, all after the last rebuilt
    region, is computed from the source when it is read. A day has one folder that is read, however many refreshes there were; a reader
    that began before the last refresh still finds its files.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], bucket: timedelta = timedelta(hours=1), policy: Policy | None = None):
        self.spark, self.path, self.build, self.bucket, self.policy = spark, path, build, bucket, policy or Policy()
        self.folder = Folder(spark, path)

    def runs(self) -> list[tuple[int, datetime]]:
        """(refresh, end of what is materialised) of the visible refreshes, oldest first."""
        found = (n.split("_") for n in self.folder.names("pointers") if not n.startswith("."))
        return sorted((int(run), ZERO + int(us) * MICRO) for run, us in found)

    def _versions(self) -> dict[str, list[int]]:
        """The visible refreshes that rebuilt each day, oldest first."""
        runs, out = self.runs(), {}
        for run in self.folder.numbers("data", "run="):
            if runs and run <= runs[-1][0]:
                for day in self.folder.names(f"data/run={run}"):
                    if day.startswith("day="):
                        out.setdefault(day, []).append(run)
        return out

    def materialised(self) -> DataFrame | None:
        days = self._versions()
        if not days:
            return None
        return self.spark.read.parquet(*(f"{self.path}/data/run={runs[-1]}/{day}" for day, runs in sorted(days.items())))

    def until(self) -> datetime | None:
        """The end of what is materialised."""
        runs = self.runs()
        return runs[-1][1] if runs else None

    def refresh(self, source: DataFrame, now: datetime, first: datetime | None = None) -> None:
        """What the policy does at ``now``; with ``first`` together with the instants from that one on."""
        self.rebuild(source, *self.policy.region(first or now, now, self.bucket))

    def rebuild(self, source: DataFrame, low: datetime | None, high: datetime) -> None:
        """Make the buckets in [low, high) anew; without ``low`` all before ``high``."""
        if low is not None and low >= high:
            return
        inside = F.col("time") < at(high)
        if low is not None:
            inside &= F.col("time") >= at(low)
        made, old = self.build(source.filter(inside)), self.materialised()
        if old is not None:
            rest = old.filter(~inside)
            if low is not None:
                days = [low.date() + timedelta(days=i) for i in range(((high - MICRO).date() - low.date()).days + 1)]
                rest = rest.filter(F.to_date("time").isin(days))
            made = made.unionByName(rest)
        runs = self.runs()
        run = runs[-1][0] + 1 if runs else 0
        made.withColumn("day", F.to_date("time")).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/data/run={run}")
        end = max(high, runs[-1][1]) if runs else high
        self.folder.mark(f"pointers/{run}_{(end - ZERO) // MICRO}")
        self._tidy([r for r, _ in runs])

    def _tidy(self, before: list[int]) -> None:
        """Drop versions of days that neither the last pointer nor the one before shows."""
        for day, runs in self._versions().items():
            last = before[-1] if before else -1
            shown = {runs[-1], *[r for r in runs if r <= last][-1:]}
            for run in set(runs) - shown:
                self.folder.drop(f"data/run={run}/{day}")
        for run, end in self.runs()[:-2]:
            self.folder.drop(f"pointers/{run}_{(end - ZERO) // MICRO}")

    def read(self, source: DataFrame) -> DataFrame:
        """Materialised buckets and the open head."""
        old, until = self.materialised(), self.until()
        head = self.build(source if until is None else source.filter(F.col("time") >= at(until)))
        return head if old is None else old.unionByName(head)


def keep_refreshed(stream: DataFrame, aggregate: ContinuousAggregate, path: str, checkpoint: str, every: str | None = None):
    """Store the rows of a stream below ``path`` and refresh the aggregate whenever its schedule is due.

    The first micro-batch materialises all that lies before the end of its region. A repeated batch finds the state before it, overwrites its rows
    and rebuilds the same region.
    """
    step = aggregate.policy.every

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        KeyedStore(spark, f"{path}/rows").write(batch, batch_id)
        clock = Snapshots(spark, f"{path}/clock")
        seen = clock.before(batch_id, "seen timestamp_ntz").first()
        _, last = _newest_time(batch)
        now = max((t for t in (last, seen and seen.seen) if t is not None), default=None)
        if now is None:
            return
        rows = stored(spark, path)
        if seen is None:
            aggregate.rebuild(rows, None, floor_to(floor_to(now, step) - aggregate.policy.end, aggregate.bucket))
        elif floor_to(now, step) > floor_to(seen.seen, step):
            aggregate.refresh(rows, floor_to(now, step), floor_to(seen.seen, step) + step)
        clock.write(spark.range(1).select(at(now).alias("seen")), batch_id)

    return _start(stream.writeStream.foreachBatch(work), checkpoint, every)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a job of this module has stored."""
    return KeyedStore(spark, f"{path}/rows").revisions().drop("_batch")


# -- several cadences over one source ------------------------------------------------------------

#: Makes an output's rows for the instants in (low, high], each with its instant in ``refreshed_at``, from the source.
Handler = Callable[[DataFrame, datetime, datetime], DataFrame]


def cadenced(
    stream: DataFrame, handlers: dict[str, Handler], path: str, checkpoint: str, cadences: dict[str, timedelta] = CADENCES, every: str | None = None
):
    """Refresh several outputs of one source, each at its own cadence.

    After every micro-batch the outputs with instants that event time has passed are refreshed, in the order of ``cadences``,
    so one may read those before it (``output``). Writes the rows, the outputs and the table of due instants
    below ``path``; a repeated batch overwrites its own part of each.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        KeyedStore(spark, f"{path}/rows").write(batch, batch_id)
        clock = Snapshots(spark, f"{path}/clock")
        seen = clock.before(batch_id, "seen timestamp_ntz").first()
        first, last = _newest_time(batch)
        before = seen.seen if seen else first
        if last is None or before is None:
            return
        now, rows = max(last, before), stored(spark, path)
        due = [(name, floor_to(before, step), floor_to(now, step), step) for name, step in cadences.items() if floor_to(now, step) > floor_to(before, step)]
        for name, low, high, _ in due:
            KeyedStore(spark, f"{path}/outputs/{name}").write(handlers[name](rows, low, high), batch_id)
        if due:
            plan = spark.createDataFrame([(n, str(low + step), str(high), step // timedelta(seconds=1)) for n, low, high, step in due], "output string, low string, high string, step long")
            times = F.sequence(F.col("low").cast("timestamp_ntz"), F.col("high").cast("timestamp_ntz"), F.make_dt_interval(secs=F.col("step")))
            KeyedStore(spark, f"{path}/due").write(plan.select("output", F.explode(times).alias("due_at")), batch_id)
        clock.write(spark.range(1).select(at(now).alias("seen")), batch_id)

    return _start(stream.writeStream.foreachBatch(work), checkpoint, every)


def output(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """An output of ``cadenced`` at all its instants so far."""
    rows = KeyedStore(spark, f"{path}/outputs/{name}").revisions()
    return None if rows is None else rows.drop("_batch")


def due_table(spark: SparkSession, path: str) -> DataFrame | None:
    """(output, due_at) of all instants so far."""
    rows = KeyedStore(spark, f"{path}/due").revisions()
    return None if rows is None else rows.drop("_batch")


# -- the screening steps -------------------------------------------------------------------------


def _bucket_end(step: timedelta) -> Column:
    """The instant that refreshes the bucket of a row."""
    secs = step // timedelta(seconds=1)
    return F.window("time", f"{secs} seconds")["end"].alias("refreshed_at")


def _between(rows: DataFrame, low: datetime, high: datetime) -> DataFrame:
    return rows.filter((F.col("time") >= at(low)) & (F.col("time") < at(high)))


def screening(spark: SparkSession, path: str, news: Column, tone: Column, min_volume: float = 1, top: int = 20, cadences: dict[str, timedelta] = CADENCES) -> dict[str, Handler]:
    """The four screening steps for ``cadenced``, over trades (symbol, time, price, size).

    factors: trades, mean price and volume of a symbol in the minute before; universe: symbols with enough volume in the day before;
    sentiment: mean ``tone`` of a symbol's rows that are ``news`` in the quarter of an hour before; rankings: of the symbols of the
    day's universe with factors in the five minutes before, the top by price change and the last sentiment.
    """

    def factors(rows: DataFrame, low: datetime, high: datetime) -> DataFrame:
        g = _between(rows, low, high).groupBy(_bucket_end(cadences["factors"]), "symbol")
        return g.agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"), F.sum("size").cast("long").alias("volume"))

    def universe(rows: DataFrame, low: datetime, high: datetime) -> DataFrame:
        g = _between(rows, low, high).groupBy(_bucket_end(cadences["universe"]), "symbol")
        return g.agg(F.sum("size").cast("long").alias("volume")).filter(F.col("volume") >= min_volume)

    def sentiment(rows: DataFrame, low: datetime, high: datetime) -> DataFrame:
        g = _between(rows, low, high).filter(news).groupBy(_bucket_end(cadences["sentiment"]), "symbol")
        return g.agg(F.avg(tone).alias("sentiment"))

    def rankings(rows: DataFrame, low: datetime, high: datetime) -> DataFrame:
        step = cadences["rankings"]
        made, day, quarter = output(spark, path, "factors"), output(spark, path, "universe"), output(spark, path, "sentiment")
        none = spark.createDataFrame([], "refreshed_at timestamp_ntz, symbol string, sentiment double")
        if made is None or day is None:
            return none.select("refreshed_at", "symbol", F.col("sentiment").alias("score"), F.lit(0).alias("rank"))
        # a minute's factors count for the ranking at or after them
        made = made.withColumn("time", F.col("refreshed_at") - F.make_dt_interval(secs=F.lit(0.000001)))
        g = _between(made, low, high).groupBy(_bucket_end(step), "symbol")
        change = g.agg((F.max_by("price", "time") / F.min_by("price", "time") - 1).alias("change"))
        whole = lambda c: F.window(F.col("refreshed_at"), f"{cadences[c] // timedelta(seconds=1)} seconds")["start"]
        change = change.withColumn("_day", whole("universe")).withColumn("_quarter", whole("sentiment"))
        listed = change.join(day.select(F.col("refreshed_at").alias("_day"), "symbol"), ["_day", "symbol"])
        told = (none if quarter is None else quarter).select(F.col("refreshed_at").alias("_quarter"), "symbol", "sentiment")
        scored = listed.join(told, ["_quarter", "symbol"], "left")
        scored = scored.select("refreshed_at", "symbol", (F.col("change") + F.coalesce("sentiment", F.lit(0.0))).alias("score"))
        best = Window.partitionBy("refreshed_at").orderBy(F.desc("score"), "symbol")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    return {"universe": universe, "sentiment": sentiment, "factors": factors, "rankings": rankings}
