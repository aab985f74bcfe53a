"""Landed files, bar store and streaming queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from barloom.operators import scoring as SC
from barloom.operators import universe as U
from barloom.operators.bars import bars_from_ticks
from barloom.operators.stats import summary
from barloom.plans import views as V
from barloom.plans.q_bars import _tick_bars
from barloom.plans.q_news import length_scorer
from barloom.plans.q_signals import DECODED, _messages
from barloom.plans.registry import final, query
from barloom.plans.sqltext import W, over
from barloom.sources import barstore as BS
from barloom.sources import landed as LD
from barloom.sources import messages as MS
from barloom.sources.stage import is_folder, new_path, stage_root
from barloom.streaming import delivery as D
from barloom.streaming import jobs as J
from barloom.streaming import refresh as R

AS_OF = "2024-01-08 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# -- landed files --------------------------------------------------------------------------------


@query(
    final(
        f"""(WITH {V.WEEKLY} SELECT symbol, time AS "timestamp", open, high, low, close, volume::DOUBLE AS volume, vwap, trade_count AS transactions FROM bars)""",
        "open high low close volume vwap",
    )
)
def vendor_aggregates(spark, sf):
    """Vendor aggregate records normalised to bars."""
    b = V.weekly_layer(spark, sf)
    ms = (F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long")
    line = F.to_json(F.struct(ms.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                              F.col("volume").cast("double").alias("v"), F.col("vwap").alias("vw"), F.col("trade_count").alias("n")))
    raw = b.select("symbol", F.from_json(line, LD.AGGREGATE).alias("r")).select("symbol", "r.*")
    return LD.normalize_aggregates(raw)


@query(final(f"""(WITH {V.DAILY} SELECT symbol, time AS "timestamp", open, high, low, close, volume FROM bars)""", "open high low close"))
def daily_history(spark, sf):
    """Daily history records normalised to bars."""
    b = V.daily_layer(spark, sf)
    raw = b.select(
        F.col("time").cast("timestamp").alias("Date"), "symbol", F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"),
    )
    return LD.normalize_daily(raw)


@query("""WITH l AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN concat('S', s_suppkey, 'test')
      WHEN s_suppkey % 10 = 2 THEN concat('LONGSYMBOL', s_suppkey) WHEN s_suppkey % 10 = 3 THEN 'File Creation Time: 0101' ELSE concat('S', s_suppkey % 9999) END AS symbol FROM supplier)
    SELECT symbol FROM l WHERE symbol IS NOT NULL AND length(symbol) <= 5 AND NOT suffix(symbol, 'test') AND NOT starts_with(symbol, 'File')""")
def listing_symbols(spark, sf):
    """Symbols of a pipe-separated listing."""
    k = F.col("s_suppkey")
    sym = (
        F.when(k % 10 == 0, "")
        .when(k % 10 == 1, F.concat(F.lit("S"), k, F.lit("test")))
        .when(k % 10 == 2, F.concat(F.lit("LONGSYMBOL"), k))
        .when(k % 10 == 3, "File Creation Time: 0101")
        .otherwise(F.concat(F.lit("S"), k % 9999))
    )
    lines = V.table(spark, sf, "supplier").select(F.concat_ws("|", sym, "s_name", F.lit("Q")).alias("value"))
    raw = lines.select(F.from_csv("value", "Symbol string, Name string, Market string", {"sep": "|"}).alias("r")).select("r.*")
    return U.listed_symbols(raw)


@query("""WITH p AS (SELECT doc_id, i, (doc_id * 3 + i * 7) % 40 AS score FROM documents, range(0, 4) r(i) WHERE i <= doc_id % 4)
    SELECT doc_id, concat('post ', doc_id, ' ', i) AS title, 'reddit_stocks' AS source, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10) AS published,
    concat('https://reddit.com/r/', doc_id, '/', i) AS url, length(substr(text, 1, 500))::INTEGER AS snippet_chars
    FROM p JOIN documents USING (doc_id) WHERE score >= 10""")
def forum_articles(spark, sf):
    """Forum listings normalised to articles."""
    i = F.col("i")
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    post = lambda i: F.struct(
        F.struct(
            F.concat(F.lit("post "), "doc_id", F.lit(" "), i).alias("title"), F.col("text").alias("selftext"),
            (F.lit(1704067200.0) + F.col("doc_id") * 600).alias("created_utc"),
            F.concat(F.lit("/r/"), "doc_id", F.lit("/"), i).alias("permalink"), ((F.col("doc_id") * 3 + i * 7) % 40).alias("score"),
        ).alias("data")
    )
    listing = F.struct(F.struct(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), post).alias("children")).alias("data"))
    raw = d.select("doc_id", F.lit("stocks").alias("forum"), F.to_json(listing).alias("value"))
    return LD.forum_articles(raw, snippet=500).select("doc_id", "title", "source", "published", "url", F.length("snippet").alias("snippet_chars"))


@query(f"""WITH p AS (SELECT doc_id, i, TIMESTAMP '2024-01-08' - to_hours(CAST((doc_id * 5 + i * 3) % 300 AS INTEGER)) AS published FROM documents, range(0, 25) r(i) WHERE i <= doc_id % 25)
    SELECT doc_id, i::INTEGER AS position, concat('item ', doc_id, ' ', i) AS title, 'google_news' AS source, published, concat('http://n.example/', doc_id, '/', i) AS url,
    concat('about ', doc_id) AS snippet FROM p WHERE i < 20 AND published >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def feed_articles(spark, sf):
    """RSS feeds normalised to articles."""
    d = V.table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id")

    def item(i):
        t = _as_of() - F.make_dt_interval(hours=((k * 5 + i * 3) % 300).cast("int"))
        date = F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss")
        return F.concat(
            F.lit("<item><title>item "), k, F.lit(" "), i, F.lit("</title><link>http://n.example/"), k, F.lit("/"), i,
            F.lit("</link><pubDate>"), date, F.lit(" GMT</pubDate><description>&lt;b&gt;about&lt;/b&gt; "), k, F.lit("</description></item>"),
        )

    items = F.array_join(F.transform(F.sequence(F.lit(0), (k % 25).cast("int")), item), "")
    raw = d.select("doc_id", F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")).alias("value"))
    return LD.feed_articles(raw, _as_of(), k=20, snippet=500)


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS li FROM pages),
    u AS (SELECT page_id, unnest(li) AS x, generate_subscripts(li, 1) - 1 AS position FROM h),
    v AS (SELECT page_id, position::INTEGER AS position, concat('Note: ', replace(regexp_extract(x, '>([^<>]*)</a>', 1), '&amp;', '&')) AS title, regexp_extract(x, 'href="([^"]*)"', 1) AS href FROM u)
    SELECT page_id, position, trim(title) AS title, CASE WHEN starts_with(href, '/') THEN concat('https://news.example.com', href) ELSE href END AS url
    FROM v WHERE position < 15 AND length(trim(title)) >= 10""")
def page_links(spark, sf):
    """Links of news pages (the pages' navigation, marked as stream items)."""
    html = F.regexp_replace("html", r'<li><a href="([^"]*)">', r'<li class="x js-stream-item"><a href="$1">Note: ')
    return LD.page_links(V.table(spark, sf, "pages").select("page_id", html.alias("html")), "https://news.example.com", k=15)


@query(f"""WITH p AS (SELECT doc_id, i FROM documents, range(0, 23) r(i) WHERE i <= doc_id % 23)
    SELECT doc_id, i::INTEGER AS position, concat('head ', i) AS title, concat('/n/', doc_id, '/', i) AS url,
    CASE (doc_id + i) % 5 WHEN 0 THEN TIMESTAMP '{AS_OF}' WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY WHEN 2 THEN TIMESTAMP '2023-12-28' ELSE TIMESTAMP '{AS_OF}' END AS published
    FROM p WHERE i < 20 AND (doc_id + i) % 5 <> 4""")
def page_news_rows(spark, sf):
    """Rows of news tables with relative and absolute dates."""
    k = F.col("doc_id")

    def row(i):
        m = (k + i) % 5
        when = F.when(m == 0, "Today 08:30AM").when(m == 1, "Yesterday 09:00PM").when(m == 2, "Dec-28-23 08:30AM").otherwise("soon")
        link = F.concat(F.lit('<a href="/n/'), k, F.lit("/"), i, F.lit('"> head '), i, F.lit(" </a>"))
        second = F.when(m == 4, F.lit("no link")).otherwise(link)
        return F.concat(F.lit("<tr><td>"), when, F.lit("</td><td>"), second, F.lit("</td></tr>"))

    rows = F.array_join(F.transform(F.sequence(F.lit(0), (k % 23).cast("int")), row), "")
    html = F.concat(F.lit('<p>x</p><table class="fullview-news-outer">'), rows, F.lit("</table>"))
    return LD.page_news_rows(V.table(spark, sf, "documents").select("doc_id", html.alias("html")), _as_of(), k=20)


# -- bar store -----------------------------------------------------------------------------------


@query(
    final(
        f"""(WITH {V.WEEKLY} SELECT symbol, time, close, CASE WHEN CAST(substr(symbol, 8) AS INTEGER) < 10 THEN 'enhanced' WHEN CAST(substr(symbol, 8) AS INTEGER) < 20
        THEN 'historical' ELSE 'day' END AS layer FROM bars)""",
        "close",
    )
)
def preferred_layer(spark, sf):
    """Every symbol from its best layer: enhanced, else historical, else daily."""
    b = V.weekly_layer(spark, sf).select(F.col("symbol").alias("Symbol"), F.col("time").alias("Date"), F.col("close").alias("Close"))
    n = F.substring("Symbol", 8, 4).cast("int")
    tag = lambda x: F.lit(x).alias("layer")
    layers = [b.filter(n < 10).select("*", tag("enhanced")), b.filter(n < 20).select("*", tag("historical")), b.select("*", tag("day"))]
    return BS.preferred(layers)


@query(final(f"(WITH {V.WEEKLY} SELECT symbol, time, close, 'even' AS tier FROM bars WHERE CAST(substr(symbol, 8) AS INTEGER) % 2 = 0)", "close"))
def tier_partition(spark, sf):
    """Bars written by tier and one tier read back."""
    path = f"{stage_root(spark)}/barloom/store-{uuid.uuid4().hex}"
    odd = F.substring("symbol", 8, 4).cast("int") % 2 == 1
    b = V.weekly_layer(spark, sf).withColumn("tier", F.when(odd, "odd").otherwise("even"))
    BS.write_bars(b, path, by=["tier"])
    return BS.load_bars(spark, path, tier="even").select("symbol", "time", "close", "tier")


@query(f"WITH {V.WEEKLY} SELECT DISTINCT symbol FROM bars")
def discovered_symbols(spark, sf):
    """Symbols of the stored bars."""
    return BS.symbols(V.weekly_layer(spark, sf))


# -- streams -------------------------------------------------------------------------------------


def _stream(spark, sf, name):
    reader, path = spark.readStream.schema(V.table(spark, sf, name).schema), f"{sf}/{name}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # a file source reads folders only


def _folders(spark):
    root = f"{stage_root(spark)}/barloom/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _tick_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        (F.col("value") + 100).alias("price"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("size"),
        F.col("event_type").alias("exchange"),
    )


HOURS = _tick_bars("date_trunc('hour', time)")


@query(final(f"(WITH {V.TICKS}, {HOURS} SELECT * FROM minute_bars)", "open high low close vwap"))
def stream_bars_1h(spark, sf):
    """Hourly bars built by a stream, newest revision of each."""
    out, checkpoint = _folders(spark)
    J.revisions(J.bars(_tick_stream(spark, sf)), out, checkpoint, ["symbol", "time"])
    return J.newest(spark, out, ["symbol", "time"])


@query(final(f"(WITH {V.TICKS}, {HOURS} SELECT * FROM minute_bars)", "open high low close vwap"))
def stream_rollup_1h(spark, sf):
    """Hourly bars rolled up by a stream of one-trade bars."""
    out, checkpoint = _folders(spark)
    t = _tick_stream(spark, sf)
    p = F.col("price")
    small = t.select(
        "symbol", "time", p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.col("size").cast("long").alias("volume"),
        F.lit(1).alias("trade_count"), p.alias("vwap"),
    )
    J.revisions(J.coarser_bars(small), out, checkpoint, ["symbol", "time"])
    return J.newest(spark, out, ["symbol", "time"])


@query(final(f"""(WITH {V.TICKS} SELECT symbol, w AS time, count(*) AS n, avg(price) AS avg_price, CAST(sum(size) AS BIGINT) AS volume FROM (
    SELECT *, date_trunc('minute', time) - to_minutes(CAST(i AS INTEGER)) AS w FROM ticks, range(0, 5) r(i)) GROUP BY 1, 2)""", "avg_price"))
def sliding_factors(spark, sf):
    """Five-minute factor inputs refreshed every minute."""
    return J.sliding_factors(V.event_ticks(spark, sf))


@query(
    final(
        f"""(WITH {V.TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time, seq) AS rn, lag(price, 20) OVER (PARTITION BY symbol ORDER BY time, seq) AS p20 FROM ticks)
        SELECT symbol, time, seq, least(110, rn)::INTEGER AS n_bars, rn >= 80 AS ready, CASE WHEN rn >= 80 THEN price / p20 - 1 END AS score FROM n)""",
        "score",
    )
)
def stream_bar_history(spark, sf):
    """Every new bar scored against its symbol's kept history."""

    def momentum():
        return lambda h: float(h["close"].iloc[-1] / h["close"].iloc[-21] - 1)

    out, checkpoint = _folders(spark)
    t = _tick_stream(spark, sf).select("symbol", "time", "seq", F.col("price").alias("close"))
    J.score_histories(t, momentum, out, checkpoint)
    return J.scores(spark, out)


@query(final(f"(WITH {V.TICKS}, {V.QUOTES} SELECT symbol, max(seq) AS seq, arg_max(bid, (time, seq)) AS bid FROM quotes GROUP BY 1)", "bid"))
def stream_latest_quote(spark, sf):
    """Newest quote per symbol, kept by a stream."""
    out, checkpoint = _folders(spark)
    t = _tick_stream(spark, sf)
    q = t.select("symbol", "time", "seq", (F.col("price") * 0.999).alias("bid"), (F.col("price") * 1.001).alias("ask"))
    J.revisions(J.latest_quotes(q), out, checkpoint, ["symbol"])
    return J.newest(spark, out, ["symbol"]).select("symbol", "seq", "bid")


@query(
    final(
        f"""(WITH {V.TICKS} SELECT symbol, rn::INTEGER AS age, time, seq, price, CAST(size AS BIGINT) AS size FROM (SELECT *, row_number() OVER
        (PARTITION BY symbol ORDER BY time DESC, seq DESC) AS rn FROM ticks) WHERE rn <= 50)""",
        "price",
    )
)
def stream_last_trades(spark, sf):
    """The newest 50 trades per symbol, kept by a stream."""
    out, checkpoint = _folders(spark)
    t = _tick_stream(spark, sf).select("symbol", "time", "seq", "price", F.col("size").cast("long").alias("size"))
    J.last_trades(t, out, checkpoint, 50)
    return J.newest_trades(spark, out, 50)


@query(
    f"""WITH RECURSIVE {V.TICKS}, n AS MATERIALIZED (SELECT symbol, time, seq, exchange NOT IN ('error', 'click') AS ok, row_number() OVER (PARTITION BY symbol ORDER BY time, seq) AS rn FROM ticks),
    r AS (SELECT symbol, 0::BIGINT AS rn, NULL::TIMESTAMP AS time, NULL::BIGINT AS seq, 'CLOSED' AS st, 'CLOSED' AS mid, 'CLOSED' AS prev, 0 AS c, 0 AS prev_c, NULL::TIMESTAMP AS lf FROM (SELECT DISTINCT symbol FROM n)
      UNION ALL SELECT symbol, rn, time, seq,
        CASE WHEN mid = 'OPEN' THEN 'OPEN' WHEN ok THEN 'CLOSED' WHEN c0 + 1 >= 5 THEN 'OPEN' ELSE mid END, mid, st0,
        CASE WHEN mid = 'OPEN' THEN c0 WHEN ok AND mid = 'HALF_OPEN' THEN 0 WHEN ok THEN c0 ELSE c0 + 1 END, c0,
        CASE WHEN mid = 'OPEN' OR ok THEN lf ELSE time END
      FROM (SELECT n.symbol, n.rn, n.time, n.seq, n.ok, r.st AS st0, r.c AS c0, r.lf,
        CASE WHEN r.st = 'OPEN' AND n.time - r.lf > INTERVAL 300 SECOND THEN 'HALF_OPEN' ELSE r.st END AS mid FROM r JOIN n ON n.symbol = r.symbol AND n.rn = r.rn + 1))
    SELECT symbol, time, seq, 'HALF_OPEN' AS state, prev_c AS failures FROM r WHERE prev = 'OPEN' AND mid = 'HALF_OPEN'
    UNION ALL SELECT symbol, time, seq, st, c FROM r WHERE rn > 0 AND st <> mid"""
)
def halt_intervals(spark, sf):
    """Trading halts folded from an outcome stream."""
    out, checkpoint = _folders(spark)
    t = J.event_time(_tick_stream(spark, sf))
    o = t.select("symbol", "time", "seq", (~F.col("exchange").isin("error", "click")).alias("ok"))
    J.halt_intervals(o, out, checkpoint)
    df = J.halts(spark, out)
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"""WITH {DECODED} SELECT 'trade' AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM de WHERE k IN (0, 1)
    UNION ALL SELECT 'quote', count(*), CAST(sum(size) AS BIGINT) FROM de WHERE k = 1 UNION ALL SELECT 'bar', count(*), CAST(sum(size) AS BIGINT) FROM de WHERE k = 2""")
def stream_dispatch(spark, sf):
    """A message stream sent to trade, quote and bar handlers."""
    out, checkpoint = _folders(spark)
    sizes = {"trade": "size", "quote": "bid_size", "bar": "volume"}

    def writer(kind):
        return lambda df, i: df.select(F.col(sizes[kind]).cast("long").alias("size")).write.mode("overwrite").parquet(f"{out}/kind={kind}/_batch={i}")

    raw = _messages_stream(spark, sf)
    J.dispatch(raw, {k: writer(k) for k in sizes}, checkpoint)
    df = spark.read.parquet(out)
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


def _messages_stream(spark, sf):
    return _messages(spark, sf, ticks=_tick_stream(spark, sf))


@query(
    final(
        """(WITH n AS (SELECT doc_id, length(text) AS n, unnest(CASE doc_id % 3 WHEN 0 THEN ['A'] WHEN 1 THEN ['A', 'B'] ELSE ['C'] END) AS symbol FROM documents)
        SELECT doc_id AS article_id, symbol, CASE WHEN n % 13 > 0 AND n % 17 > 0 THEN greatest(-1, least(1, (n % 31 - 15) / 10.0))::DOUBLE END AS sentiment FROM n)""",
        "sentiment",
    )
)
def stream_articles(spark, sf):
    """Article stream: scored, one row per symbol, stored by key."""
    out, checkpoint = _folders(spark)
    d = _stream(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "text")
    k = F.col("article_id") % 3
    a = lambda *x: F.array(*(F.lit(i) for i in x))
    symbols = F.when(k == 0, a("A")).when(k == 1, a("A", "B", "B")).otherwise(a("C"))
    J.articles(d, symbols, lambda df: SC.score_texts(df, length_scorer), out, checkpoint)
    return J.newest(spark, out, ["article_id", "symbol"]).select("article_id", "symbol", "sentiment")


@query(final(f"(WITH {V.TICKS} SELECT symbol, 'SIGNAL' AS event_type, CAST(seq AS BIGINT) AS seq, price AS composite FROM ticks)", "composite"))
def stream_audit(spark, sf):
    """Audit rows appended by a signal stream."""
    out, checkpoint = _folders(spark)
    t = _tick_stream(spark, sf).select(
        "symbol", "time", F.col("price").alias("composite_signal"), F.col("seq").cast("string").alias("action"), F.lit(1.0).alias("confidence")
    )
    J.audit(t, out, checkpoint)
    rows = spark.read.schema("event_type string, symbol string, details string").json(f"{out}/day=*")
    d = F.from_json("details", "composite double, action string")
    return rows.select("symbol", "event_type", d["action"].cast("long").alias("seq"), d["composite"].alias("composite"))


# -- refreshed results ---------------------------------------------------------------------------


def _hourly(ticks):
    return bars_from_ticks(ticks, "1h", order=("time", "seq"))


@query(
    final(
        f"""(WITH {V.TICKS.replace("ticks AS", "all_ticks AS")}, ticks AS (SELECT t.* FROM all_ticks t, (SELECT date_trunc('hour', max(time)) AS now FROM all_ticks)
        WHERE time >= now - INTERVAL 3 HOUR OR seq % 10 <> 3), {HOURS} SELECT * FROM minute_bars)""",
        "open high low close vwap",
    )
)
def continuous_bars(spark, sf):
    """Hourly bars under a refresh policy: every tenth tick came after its hour had been materialised, and counts where the next refresh reaches."""
    ticks = V.event_ticks(spark, sf)
    now = datetime.fromisoformat(ticks.agg(F.date_trunc("hour", F.max("time")).cast("string")).first()[0])
    early = ticks.filter((F.col("seq") % 10 != 3) & (F.col("time") < R.at(now - R.REFRESH["every"])))
    bars = R.ContinuousAggregate(spark, new_path(spark, "continuous"), _hourly)
    bars.rebuild(early, None, now - R.REFRESH["every"] - bars.policy.end)
    bars.refresh(ticks, now)
    return bars.read(ticks)


@query(
    final(
        f"""(WITH {V.TICKS.replace("ticks AS", "all_ticks AS")}, ticks AS (SELECT * FROM all_ticks WHERE time < (SELECT date_trunc('hour', max(time)) - INTERVAL 1 HOUR FROM all_ticks)),
        {HOURS} SELECT * FROM minute_bars)""",
        "open high low close vwap",
    )
)
def stream_continuous_bars(spark, sf):
    """What a stream of ticks has materialised under the policy: all but the open head."""
    out, checkpoint = _folders(spark)
    bars = R.ContinuousAggregate(spark, f"{out}/bars", _hourly)
    R.keep_refreshed(_tick_stream(spark, sf), bars, out, checkpoint)
    return bars.materialised()


def _screened(spark, sf):
    out, checkpoint = _folders(spark)
    steps = R.screening(spark, out, news=F.col("exchange") == "click", tone=(F.col("seq") % 21 - 10) / 10)
    R.cadenced(_tick_stream(spark, sf), steps, out, checkpoint)
    return out


SPANS = {"factors": 60, "rankings": 300, "sentiment": 900, "universe": 86400}
DUE = " UNION ALL ".join(
    f"""SELECT '{n}' AS output, unnest(generate_series(time_bucket(INTERVAL {s} SECOND, a, TIMESTAMP '1970-01-01') + INTERVAL {s} SECOND,
    time_bucket(INTERVAL {s} SECOND, b, TIMESTAMP '1970-01-01'), INTERVAL {s} SECOND)) AS due_at FROM span"""
    for n, s in SPANS.items()
)


def _bucket(column: str, step: str, shift: int = 1) -> str:
    s = SPANS[step]
    return f"time_bucket(INTERVAL {s} SECOND, {column}, TIMESTAMP '1970-01-01') + INTERVAL {s * shift} SECOND"


SCREENED = f"""{V.TICKS}, span AS (SELECT min(time) AS a, max(time) AS b FROM ticks), due AS ({DUE}),
  f AS (SELECT {_bucket("time", "factors")} AS t, symbol, avg(price) AS price FROM ticks GROUP BY 1, 2),
  u AS (SELECT {_bucket("time", "universe")} AS t, symbol FROM ticks GROUP BY 1, 2 HAVING sum(size) >= 1),
  s AS (SELECT {_bucket("time", "sentiment")} AS t, symbol, avg((seq % 21 - 10) / 10) AS sentiment FROM ticks WHERE exchange = 'click' GROUP BY 1, 2),
  g AS (SELECT {_bucket("t - INTERVAL 1 MICROSECOND", "rankings")} AS t, symbol, arg_max(price, f.t) / arg_min(price, f.t) - 1 AS change FROM f GROUP BY 1, 2),
  sc AS (SELECT g.t, g.symbol, change + coalesce(sentiment, 0) AS score FROM g JOIN u ON u.symbol = g.symbol AND u.t = {_bucket("g.t", "universe", 0)}
    LEFT JOIN s ON s.symbol = g.symbol AND s.t = {_bucket("g.t", "sentiment", 0)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, symbol) AS rank FROM sc)"""


@query(f"""WITH {SCREENED}, made AS (SELECT 'factors' AS output, t, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'universe', t, count(*) FROM u GROUP BY ALL
    UNION ALL SELECT 'sentiment', t, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'rankings', t, count(*) FROM r WHERE rank <= 20 GROUP BY ALL)
    SELECT due.output, due_at, coalesce(n, 0) AS n FROM due LEFT JOIN made ON made.output = due.output AND t = due_at""")
def cadence_due(spark, sf):
    """When event time made which output due, and how many rows each refresh gave."""
    out = _screened(spark, sf)
    made = None
    for name in SPANS:
        part = R.output(spark, out, name).groupBy("refreshed_at").agg(F.count(F.lit(1)).alias("n")).withColumn("output", F.lit(name))
        made = part if made is None else made.unionByName(part)
    due = R.due_table(spark, out)
    found = due.join(made.withColumnRenamed("refreshed_at", "due_at"), ["output", "due_at"], "left")
    return found.select("output", "due_at", F.coalesce("n", F.lit(0)).alias("n"))


@query(final(f"(WITH {SCREENED} SELECT r.t AS refreshed_at, symbol, rank::INTEGER AS rank, score FROM r JOIN due ON output = 'rankings' AND due_at = r.t WHERE rank <= 20)", "score"))
def cadenced_rankings(spark, sf):
    """Rankings every five minutes, from factors of a minute, sentiment of a quarter of an hour and the day's universe."""
    return R.output(spark, _screened(spark, sf), "rankings").select("refreshed_at", "symbol", "rank", "score")


@query(
    final(
        f"""(WITH {V.TICKS} SELECT seq, 'TRADE' AS topic, symbol, price FROM ticks
        UNION ALL SELECT seq, 'SIGNAL', symbol, price / 500 FROM ticks WHERE exchange IN ('click', 'purchase'))""",
        "price",
    )
)
def published_messages(spark, sf):
    """Trades and signals of a stream sent to topics; a batch is repeated, and once more after a loss of the ledger; each message is read once."""
    out, checkpoint = _folders(spark)
    t = _tick_stream(spark, sf).withColumn("timestamp", MS.timestamp_to_ns(F.col("time")))
    named = t.withColumns({"symbol": F.concat_ws("|", "symbol", "seq"), "signal_type": F.lit("BUY"), "strength": F.col("price") / 500, "source": F.lit("model")})
    rows = MS.to_topic(named, "TRADE").unionByName(MS.to_topic(named.filter(F.col("exchange").isin("click", "purchase")), "SIGNAL"))
    first = D.Publisher(f"{out}/ledger", "parquet", {"path": f"{out}/topics"}, ["TRADE", "SIGNAL"])
    D.publish(rows, first, checkpoint)
    sent = spark.read.schema("key string, value string, id string, topic string").option("basePath", f"{out}/topics").parquet(f"{out}/topics/topic=*")
    again = sent.drop("id")
    first(again, 0)
    D.Publisher(f"{out}/lost", "parquet", {"path": f"{out}/topics"}, ["SIGNAL"])(again, 0)
    got = D.sent_files(spark, f"{out}/topics")
    at = F.split("symbol", r"\|")
    parts = [("TRADE", "price"), ("SIGNAL", "strength")]
    both = [MS.from_topic(got, n).select(at[1].cast("long").alias("seq"), F.lit(n).alias("topic"), at[0].alias("symbol"), F.col(c).alias("price")) for n, c in parts]
    return both[0].unionByName(both[1])


@query(
    final(
        f"""(WITH {V.TICKS} SELECT seq, symbol, price AS composite, CASE WHEN price > 150 THEN 'BUY' ELSE 'HOLD' END AS action, price * 0.95::DOUBLE AS stop_loss FROM ticks)""",
        "composite stop_loss",
    )
)
def signal_messages(spark, sf):
    """Signal messages of a dashboard, written and read back."""
    path, price = new_path(spark, "signals"), F.col("price")
    names = ("technical_signal", "prediction_signal", "sentiment_signal", "confidence", "position_size", "take_profit", "expected_return")
    t = V.event_ticks(spark, sf).withColumns({n: F.lit(0.5) for n in names})
    t = t.withColumns({"composite_signal": price, "action": F.when(price > 150, "BUY").otherwise("HOLD"), "stop_loss": price * 0.95})
    MS.signal_message(t.withColumn("symbol", F.concat_ws("|", "symbol", "seq"))).select("value").write.text(path)
    body = F.from_json("value", "type string, symbol string, composite double, action string, stop_loss double").alias("m")
    m = spark.read.text(path).select(body).filter("m.type = 'signal'").select("m.*")
    at = F.split("symbol", r"\|")
    return m.select(at[1].cast("long").alias("seq"), at[0].alias("symbol"), "composite", "action", "stop_loss")


@query(
    final(
        f"""(WITH {V.TICKS} SELECT CAST(time AS DATE) AS day, event_type, count(*) AS n, sum(composite) AS total FROM (
        SELECT time, 'SIGNAL' AS event_type, price AS composite FROM ticks UNION ALL SELECT time, 'ORDER', price * 2 FROM ticks WHERE size > 5) GROUP BY ALL)""",
        "total", digits=4,
    ),
    digits=4,
)
def audit_log(spark, sf):
    """Signals and orders appended to one audit log, which is read back by day."""
    path, t = new_path(spark, "audit"), V.event_ticks(spark, sf)
    signals = t.withColumns({"composite_signal": F.col("price"), "action": F.lit("BUY"), "confidence": F.lit(1.0)})
    orders = t.filter("size > 5").withColumns({"side": F.lit("BUY"), "quantity": F.col("size"), "price": F.col("price") * 2, "reason": F.lit(None).cast("string")})
    MS.append_audit(MS.audit_signals(signals), path)
    MS.append_audit(MS.audit_orders(orders), path)
    rows = spark.read.schema("event_type string, symbol string, details string, day date").option("basePath", path).json(path)
    d = F.from_json("details", "composite double, price double")
    return rows.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(d["composite"], d["price"])).alias("total"))
