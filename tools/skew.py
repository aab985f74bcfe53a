"""Measure the feature families on a skewed table: one symbol holds a third of all rows.

    python tools/skew.py [rows] [symbols]

Compares the block form with the same windows over whole symbols (rows in the millions show it best).
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from barloom.functions.series import Series, number_rows  # noqa: E402
from barloom.operators import context, technical  # noqa: E402
from barloom.session import local_session  # noqa: E402
from barloom.sources.stage import stage  # noqa: E402


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 40
    spark = local_session(8, 32)
    i = F.col("id")
    bars = spark.range(n).select(
        F.when(i % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), i % k)).alias("symbol"),
        F.timestamp_seconds(i * 60).cast("timestamp_ntz").alias("time"),
        (F.sin(i / 1000.0) * 10 + 100).alias("open"),
        (F.sin(i / 1000.0) * 10 + 101).alias("high"),
        (F.sin(i / 1000.0) * 10 + 99).alias("low"),
        (F.sin((i + 3) / 1000.0) * 10 + 100).alias("close"),
        (i % 977 + 1).alias("volume"),
    )
    bars = stage(bars)

    def timed(name, df):
        t = time.time()
        df.write.format("noop").mode("overwrite").save()
        print(f"{name:48s} {time.time() - t:7.1f} s", flush=True)

    t = time.time()
    numbered = stage(number_rows(bars))
    print(f"{'number rows, write':48s} {time.time() - t:7.1f} s", flush=True)
    timed("technical windows, blocks", technical.windows(Series.of(numbered, behind=200)).own())
    whole = Series(bars.withColumn("_t", F.lit(0)).withColumn("_own", F.lit(True)).withColumn("_blk", F.lit(0)), ["symbol"], 1 << 40)
    whole.w = Window.partitionBy("symbol").orderBy("time")

    class Whole(Series):
        def _with(self, df):
            out = Whole(df, self.key, self.size)
            out.w = self.w
            return out

    w = Whole(whole.df, ["symbol"], 1 << 40)
    w.w = whole.w
    timed("technical windows, whole symbols", technical.windows(w).own())
    timed("averages with carry, blocks", technical.recursive(Series.of(numbered, behind=0)).own())
    hot_hour(spark, n, k, timed)


def hot_hour(spark, n, k, timed):
    """Trades and quotes of which one symbol has a third in one hour: the largest group of the as-of join."""
    i = F.col("id")
    hot = i % 3 == 0
    when = F.when(hot, F.timestamp_micros((i * 3_600_000_000 / n).cast("long"))).otherwise(F.timestamp_seconds(i * 60))
    ticks = spark.range(n).select(F.when(hot, "HOT").otherwise(F.concat(F.lit("S"), i % k)).alias("symbol"), when.cast("timestamp_ntz").alias("time"), i.alias("seq"))
    trades = stage(ticks.filter(i % 2 == 0).withColumn("price", F.lit(1.0)))
    quotes = stage(ticks.filter(i % 2 == 1).withColumn("quote", F.col("seq") * 1.0))
    timed("as-of join, hot hour, chunks of rows", context.as_of(trades, quotes, ["quote"]))
    timed("as-of join, hot hour, chunks of an hour", context.as_of(trades, quotes, ["quote"], chunk="hour"))
    both = trades.select("symbol", "time").union(quotes.select("symbol", "time")).withColumns({"_at": F.col("time"), "_o": F.col("time")})
    for chunk in (None, "hour"):
        groups = context.chunked(both, ["symbol"], chunk)[0].groupBy("_g").count()
        print(f"largest group, chunk {chunk or 'of rows':38s} {groups.agg(F.max('count')).first()[0]:9d} rows", flush=True)


if __name__ == "__main__":
    main()
