"""Knowledge-graph records: 27 tab-separated columns, one news document per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.taxonomy import company_tickers

WIDTH = 27

# Positions (0-based) of the columns that are used.
DATE, SOURCE, URL, THEMES, LOCATIONS, PERSONS, ORGANIZATIONS, TONE = 1, 3, 4, 7, 9, 11, 13, 15

# Theme fragments that mark market news.
THEME_TOKENS = (
    "ECON_", "BUS_", "TAX_", "TRADE_", "MANMADE_DISASTER", "BANKRUPTCY", "MERGER", "ACQUISITION", "IPO",
    "EARNINGS", "SEC_", "FRAUD", "LAWSUIT", "REGULATION", "TARIFF",
)


def read_graph_records(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of the files under a path."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """date, url, source, tone, themes, organizations, persons, locations, word_count.

    Lines with too many fields are skipped; missing trailing fields are null. A record whose date, tone or
    word count does not parse is dropped. Other columns of ``lines`` are kept.
    """
    keep = [c for c in lines.columns if c != line]
    parts = lines.withColumn("_f", F.split(line, "\t")).filter(F.size("_f") <= WIDTH)
    f = lambda i: F.nullif(F.try_element_at("_f", F.lit(i + 1)), F.lit(""))
    listed = lambda i: F.coalesce(F.split(f(i), ";"), F.array().cast("array<string>"))
    lowered = lambda i: F.filter(F.transform(listed(i), F.lower), lambda x: x != "")
    tone = F.split(f(TONE), ",")
    first, fifth = F.try_element_at(tone, F.lit(1)), F.try_element_at(tone, F.lit(5))
    parsed = parts.select(
        *keep,
        F.expr("try_to_date(substr(try_element_at(_f, 2), 1, 8), 'yyyyMMdd')").alias("date"),
        f(URL).alias("url"),
        f(SOURCE).alias("source"),
        first.try_cast("double").alias("tone"),
        listed(THEMES).alias("themes"),
        lowered(ORGANIZATIONS).alias("organizations"),
        lowered(PERSONS).alias("persons"),
        listed(LOCATIONS).alias("locations"),
        F.when(fifth.isNull(), F.lit(0.0)).otherwise(fifth.try_cast("double")).cast("int").alias("word_count"),
        f(TONE).isNull().alias("_no_tone"),
    )
    good = F.col("date").isNotNull() & (F.col("tone").isNotNull() | F.col("_no_tone")) & F.col("word_count").isNotNull()
    return parsed.filter(good).drop("_no_tone")


def has_market_theme(themes: Column) -> Column:
    """Any theme contains any of the fragments, ignoring case."""
    pattern = "|".join(THEME_TOKENS)
    return F.exists(themes, lambda t: F.upper(t).rlike(pattern))


def tickers(organizations: Column, extra: dict[str, str] | None = None) -> Column:
    """Distinct tickers of the organisations that the company dictionary knows."""
    names = company_tickers(extra)
    found = F.transform(organizations, lambda o: F.try_element_at(names, F.trim(F.lower(o))))
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull()))


def market_relevant(records: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Records with a market theme, or, where symbols are given, that mention one of them."""
    keep = has_market_theme(F.col("themes"))
    if symbols:
        wanted = F.array(*(F.lit(s) for s in symbols))
        keep = keep | F.arrays_overlap(tickers(F.col("organizations")), wanted)
    return records.filter(keep)


def mentions(records: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """One row per record and distinct ticker it mentions."""
    return records.withColumn("ticker", F.explode(tickers(F.col("organizations"), extra)))


def new_days(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records of days that are not stored yet (read-through by day)."""
    return records.join(stored.select("date").distinct(), "date", "left_anti")


def sentiment_by_day(lines: DataFrame, symbols: Sequence[str] | None = None, score: str = "tone") -> DataFrame:
    """From raw lines to daily ticker sentiment."""
    from barloom.operators.news import ticker_sentiment

    return ticker_sentiment(mentions(market_relevant(parse_lines(lines), symbols)), score)
