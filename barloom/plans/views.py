"""Market-shaped views of the test tables, in Spark and as SQL text for the comparison side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.series import number_rows
from barloom.operators.bars import bars_from_ticks
from barloom.sources.stage import layer

TICK_ORDER = ("tick",)


def tick_number() -> Column:
    """Ship date, order, line and part of an order line as one number: 6, 13, 2 and 13 digits."""
    out = F.unix_date(F.to_date("l_shipdate")).cast("decimal(38,0)")
    for name, digits in (("l_orderkey", 13), ("l_linenumber", 2), ("l_partkey", 13)):
        out = (out * F.lit(10**digits).cast("decimal(14,0)") + F.col(name)).cast("decimal(38,0)")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line is a trade: symbol = supplier nation, price = unit price, size = quantity."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("symbol"),
            F.col("n_regionkey"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("size"),
            "l_shipdate",
            tick_number().alias("tick"),
        )
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(line_ticks(spark, sf_dir), "week", time="l_shipdate", order=TICK_ORDER)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per region, daily bars."""
    ticks = line_ticks(spark, sf_dir).withColumn("symbol", F.concat(F.lit("R"), F.col("n_regionkey")))
    return bars_from_ticks(ticks, "1d", time="l_shipdate", order=TICK_ORDER)


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trades as one series."""
    ticks = line_ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    return bars_from_ticks(ticks, "week", time="l_shipdate", order=TICK_ORDER)


# The bar layers the indicator queries read, like any store of bars: built from the trades once, rows
# numbered within their symbol.


def _numbered(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    return layer(spark, f"numbered {name}", sf_dir, lambda: number_rows(layer(spark, name, sf_dir, build)))


def weekly_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, "weekly", sf_dir, lambda: weekly_bars(spark, sf_dir))


def daily_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, "daily", sf_dir, lambda: daily_bars(spark, sf_dir))


def benchmark_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, "benchmark", sf_dir, lambda: benchmark_bars(spark, sf_dir))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as trades: one symbol per user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        (F.col("value") + 100).alias("price"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("size"),
        F.col("event_type").alias("exchange"),
    )


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(spark, sf_dir).select(
        "symbol",
        "time",
        "seq",
        (F.col("price") * 0.999).alias("bid"),
        (F.col("price") * 1.001).alias("ask"),
        F.col("size").alias("bid_size"),
        F.col("size").alias("ask_size"),
    )


# Source names with a credibility weight, in a fixed order.
SOURCE_NAMES = ("reuters", "bloomberg", "wsj", "cnbc", "benzinga", "seekingalpha", "motleyfool", "unknown")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news articles about the 25 nations; scores where a label exists."""
    t = lambda n: table(spark, sf_dir, n)
    names = F.array(*(F.lit(s) for s in SOURCE_NAMES))
    return (
        t("documents")
        .join(t("labels"), "doc_id", "left")
        .join(t("nation"), F.col("doc_id") % 25 == F.col("n_nationkey"))
        .select(
            F.col("doc_id").alias("article_id"),
            F.col("n_name").alias("symbol"),
            F.col("text").alias("title"),
            names[(F.col("doc_id") % 8).cast("int")].alias("source"),
            F.col("source").alias("url"),
            (
                F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                + F.make_dt_interval(mins=(F.col("doc_id") * 10).cast("int"))
            ).alias("published"),
            F.greatest(
                F.lit(-1.0), F.least(F.lit(1.0), F.col("quality") - F.col("toxic") - F.lit(0.5))
            ).alias("_s"),
            F.col("quality").isNotNull().alias("_scored"),
            (F.lit(0.5) + F.col("quality") * F.lit(0.5)).alias("confidence"),
            "text",
        )
        .withColumn("sentiment", F.when(F.col("_scored"), F.col("_s").cast("double")))
        .withColumn("confidence", F.col("confidence").cast("double"))
        .drop("_s", "_scored")
    )


# -- the same views as SQL ---------------------------------------------------------------------

LINES = """lines AS (
  SELECT n_name AS symbol, n_regionkey, l_extendedprice / l_quantity AS price, l_quantity AS size,
         l_shipdate, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _bars(name: str, symbol: str, unit: str) -> str:
    key = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
    return f"""{name} AS (
  SELECT {symbol} AS symbol, date_trunc('{unit}', l_shipdate) AS time,
         first(price ORDER BY {key}) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {key}) AS close, CAST(sum(size) AS BIGINT) AS volume,
         count(*) AS trade_count, sum(price * size) / sum(size) AS vwap
  FROM lines GROUP BY 1, 2)"""


WEEKLY = f"{LINES}, {_bars('bars', 'symbol', 'week')}"
DAILY = f"{LINES}, {_bars('bars', 'concat(chr(82), n_regionkey)', 'day')}"
BENCH = _bars("bench", "'ALL'", "week")

TICKS = """ticks AS (
  SELECT concat('U', user_id) AS symbol, ts AS time, event_id AS seq, value + 100 AS price,
         CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS size, event_type AS exchange
  FROM events)"""

QUOTES = """quotes AS (
  SELECT symbol, time, seq, price * 0.999::DOUBLE AS bid, price * 1.001::DOUBLE AS ask,
         size AS bid_size, size AS ask_size FROM ticks)"""

ARTICLES = """articles AS (
  SELECT d.doc_id AS article_id, n_name AS symbol, d.text AS title,
         ['reuters', 'bloomberg', 'wsj', 'cnbc', 'benzinga', 'seekingalpha', 'motleyfool', 'unknown'][1 + d.doc_id % 8] AS source,
         d.source AS url,
         TIMESTAMP '2024-01-01' + to_minutes(d.doc_id * 10) AS published,
         CASE WHEN l.quality IS NOT NULL
              THEN greatest(-1.0, least(1.0, l.quality - l.toxic - 0.5))::DOUBLE END AS sentiment,
         (0.5 + 0.5 * l.quality)::DOUBLE AS confidence, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  JOIN nation ON d.doc_id % 25 = n_nationkey)"""
