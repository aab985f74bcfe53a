"""Landed vendor files brought into the bar and article schemas. Fetching is not done here."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATE = "t bigint, o double, h double, l double, c double, v double, vw double, n bigint"
DELISTED_CSV = "symbol string, company_name string, delist_reason string, delist_year int"


def read_aggregates(spark: SparkSession, path: str) -> DataFrame:
    """Vendor aggregates stored as {symbol, results: [...]} documents."""
    raw = spark.read.schema(f"symbol string, results array<struct<{_struct(AGGREGATE)}>>").json(path)
    return normalize_aggregates(raw.select("symbol", F.explode("results").alias("r")).select("symbol", "r.*"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (p.split() for p in ddl.split(", ")))


def normalize_aggregates(raw: DataFrame) -> DataFrame:
    """Short vendor names to bar names, milliseconds to times; optional columns only where they exist."""
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "transactions"}
    cols = [F.col(a).alias(b) for a, b in names.items() if a in raw.columns]
    return raw.select(F.timestamp_millis("t").cast("timestamp_ntz").alias("timestamp"), "symbol", *cols)


def normalize_daily(raw: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Daily history (Date, Open, High, Low, Close, Volume) to bar columns without time zone."""
    names = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
    time = F.col("Date").cast("timestamp_ntz").alias("timestamp")
    sym = (F.col("symbol") if symbol is None else symbol).alias("symbol")
    return raw.select(time, sym, *(F.col(a).alias(b) for a, b in names.items() if a in raw.columns))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated listing file with a header."""
    return spark.read.csv(path, sep="|", header=True)


def read_delisted_csv(spark: SparkSession, path: str) -> DataFrame:
    """The local bulk file of delisted symbols."""
    return spark.read.csv(path, header=True, schema=DELISTED_CSV)


FORUM = (
    "data struct<children: array<struct<data: struct<title: string, selftext: string, created_utc: double, "
    "permalink: string, score: bigint>>>>"
)


def _head(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def forum_articles(raw: DataFrame, text: str = "value", min_score: int = 10, snippet: int | None = None) -> DataFrame:
    """Forum listings (JSON text, forum) to articles: score at least 10; ``snippet``: characters kept of the text, None all."""
    posts = raw.withColumn("_p", F.explode(F.from_json(text, FORUM)["data"]["children"])).withColumn("_p", F.col("_p.data"))
    rest = [c for c in raw.columns if c != text]
    return posts.filter(F.coalesce(F.col("_p.score"), F.lit(0)) >= min_score).select(
        *rest,
        F.coalesce(F.col("_p.title"), F.lit("")).alias("title"),
        F.concat(F.lit("reddit_"), "forum").alias("source"),
        F.timestamp_seconds(F.coalesce(F.col("_p.created_utc"), F.lit(0.0))).cast("timestamp_ntz").alias("published"),
        F.concat(F.lit("https://reddit.com"), F.coalesce(F.col("_p.permalink"), F.lit(""))).alias("url"),
        _head(F.coalesce(F.col("_p.selftext"), F.lit("")), snippet).alias("snippet"),
    )


RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>"


def feed_articles(raw: DataFrame, as_of: Column, text: str = "value", days_back: int = 7, k: int | None = None, snippet: int | None = None) -> DataFrame:
    """RSS feeds (XML text, one per query) to articles.

    All entries of a feed, or the first ``k``; entries without a readable date or older than ``days_back`` are dropped;
    the snippet is the description without tags, or its first ``snippet`` characters.
    """
    rest = [c for c in raw.columns if c != text]
    items = _first(F.from_xml(text, RSS)["channel"]["item"], k)
    e = raw.select(*rest, F.posexplode(items).alias("position", "e"))
    # "Mon, 01 Jan 2024 00:10:00 GMT": the weekday and the zone are fixed parts
    stamp = F.regexp_extract(F.col("e.pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    out = e.select(
        *rest,
        "position",
        F.col("e.title").alias("title"),
        F.lit("google_news").alias("source"),
        F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz").alias("published"),
        F.col("e.link").alias("url"),
        _head(F.regexp_replace(F.coalesce("e.description", F.lit("")), "<[^>]+>", ""), snippet).alias("snippet"),
    )
    return out.filter(F.col("published") >= as_of - F.make_dt_interval(days=F.lit(days_back)))


class _Items(HTMLParser):
    """Collects (title, href) of the first link in every list item of a class."""

    def __init__(self, mark: str):
        super().__init__()
        self.mark = re.compile(mark)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.link: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "li":
            hit = any(self.mark.search(c) for c in (a.get("class") or "").split())
            item = {"hit": hit, "title": [], "href": None}
            self.open.append(item)
            if hit:
                self.done.append(item)
        elif tag == "a":
            for item in self.open:
                if item["hit"] and item["href"] is None:
                    item["href"] = a.get("href") or ""
                    self.link = item
                    break

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        elif tag == "li" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.link is not None:
            self.link["title"].append(data.strip())


class _Rows(HTMLParser):
    """Collects (first cell, link title, href) of every row of a table with a given class."""

    def __init__(self, mark: str):
        super().__init__()
        self.mark = mark
        self.depth = 0
        self.rows: list[dict] = []
        self.cell = -1
        self.in_link = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            if self.depth or self.mark in (a.get("class") or "").split():
                self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append({"cells": 0, "when": [], "title": [], "href": None})
            self.cell = -1
        elif self.depth and tag == "td" and self.rows:
            self.cell += 1
            self.rows[-1]["cells"] += 1
        elif self.depth and tag == "a" and self.cell == 1 and self.rows[-1]["href"] is None:
            self.rows[-1]["href"] = a.get("href") or ""
            self.in_link = True

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data):
        if not self.depth or not self.rows:
            return
        if self.cell == 0:
            self.rows[-1]["when"].append(data.strip())
        elif self.in_link:
            self.rows[-1]["title"].append(data.strip())


LINK = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("href", T.StringType())]))
ROW = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("moment", "title", "href")])
)


@F.pandas_udf(LINK)
def _item_links(html: pd.Series) -> pd.Series:
    def links(text):
        p = _Items("stream-item")
        p.feed(text or "")
        return [{"title": "".join(i["title"]), "href": i["href"]} for i in p.done]

    return html.map(links)


@F.pandas_udf(ROW)
def _table_rows(html: pd.Series) -> pd.Series:
    def rows(text):
        p = _Rows("fullview-news-outer")
        p.feed(text or "")
        return [
            {"moment": "".join(r["when"]), "title": "".join(r["title"]), "href": r["href"] if r["cells"] >= 2 else None}
            for r in p.rows
        ]

    return html.map(rows)


def page_links(pages: DataFrame, site: str, html: str = "html", k: int | None = None, min_title: int = 10) -> DataFrame:
    """News pages to links: all stream items or the first ``k``, titles of at least 10 characters, absolute URLs."""
    rest = [c for c in pages.columns if c != html]
    links = _first(_item_links(F.col(html)), k)
    out = pages.select(*rest, F.posexplode(links).alias("position", "l"))
    out = out.filter(F.col("l.href").isNotNull() & (F.length("l.title") >= min_title))
    href = F.col("l.href")
    url = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(site), href)).otherwise(href)
    return out.select(*rest, "position", F.col("l.title").alias("title"), url.alias("url"))


def page_news_rows(pages: DataFrame, as_of: Column, html: str = "html", k: int | None = None) -> DataFrame:
    """News tables to articles: all rows or the first ``k``; Today, Yesterday or a date like Dec-28-24, else now."""
    rest = [c for c in pages.columns if c != html]
    rows = _first(_table_rows(F.col(html)), k)
    out = pages.select(*rest, F.posexplode(rows).alias("position", "r")).filter(F.col("r.href").isNotNull())
    when = F.col("r.moment")
    day = F.try_to_timestamp(F.element_at(F.split(F.trim(when), r"\s+"), 1), F.lit("MMM-dd-yy")).cast("timestamp_ntz")
    published = (
        F.when(F.contains(when, F.lit("Today")), as_of)
        .when(F.contains(when, F.lit("Yesterday")), as_of - F.make_dt_interval(days=F.lit(1)))
        .otherwise(F.coalesce(day, as_of))
    )
    return out.select(
        *rest, "position", F.col("r.title").alias("title"), F.col("r.href").alias("url"), published.alias("published")
    )
