"""Rows that are easily lost: null keys and times, null values, missing positions, repeated keys, late differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.series import Series, number_rows, span_term
from barloom.operators import context as CX
from barloom.operators import news as N
from barloom.plans import views as V
from barloom.plans.q_news import HASHED, _hashed
from barloom.plans.registry import final, query

SPARSE = """o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN concat('C', o_custkey % 50) END AS symbol,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS time, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price FROM orders)"""


def _sparse(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(c % 10 != 0, F.concat(F.lit("C"), c % 50)).alias("symbol"),
        F.when(k % 7 != 0, F.col("o_orderdate")).alias("time"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"),
    )


@query(f"""WITH {SPARSE} SELECT o_orderkey, row_number() OVER (PARTITION BY symbol ORDER BY time NULLS FIRST, o_orderkey) - 1 AS position FROM o""")
def numbered_with_nulls(spark, sf):
    """Positions of orders, with null symbols and null times."""
    return number_rows(_sparse(spark, sf), order=["time", "o_orderkey"]).select("o_orderkey", F.col("_t").alias("position"))


@query(
    final(
        f"""(WITH {SPARSE}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time NULLS FIRST, o_orderkey) AS rn FROM o)
        SELECT o_orderkey, coalesce(sum(price) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS total,
        avg(price) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE AS mean_5 FROM n)""",
        "total mean_5",
        digits=4,
    )
)
def windows_with_nulls(spark, sf):
    """Running totals and trailing means over rows with null keys, times and values."""
    s = Series.of(_sparse(spark, sf), behind=4, order=["time", "o_orderkey"])
    s = s.with_columns(mean_5=F.avg("price").over(s.rows(5))).accumulate({"total": (F.col("price").cast("double"), 1.0)})
    out = s.own().select("o_orderkey", F.round("total", 4).alias("total"), F.round("mean_5", 4).alias("mean_5"))
    return out


@query(
    final(
        f"""(WITH {V.WEEKLY}, n AS (SELECT symbol, time, volume, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS t FROM bars),
        k AS (SELECT * FROM n WHERE t % 64 < 48 OR t % 3 = 0) SELECT symbol, time,
        sum(volume) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)::DOUBLE AS total,
        list_sum(list_transform(list({{'t': t, 'v': volume}}) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING),
          lambda x: (CASE WHEN x.t = 0 THEN 1 ELSE 2.0 / 6 END) * x.v * pow(4.0 / 6, t - x.t))) AS ema FROM k)""",
        "total ema",
    )
)
def running_over_gaps(spark, sf):
    """Running total and recursive average over a stored layer of which rows have been filtered out."""
    t = F.col("_t")
    kept = V.weekly_layer(spark, sf).filter((t % 64 < 48) | (t % 3 == 0))
    s = Series.of(kept, behind=0, size=32).accumulate({"total": (F.col("volume").cast("double"), 1.0), "ema": span_term("volume", 5)})
    return s.own(keep_t=False).select("symbol", "time", "total", "ema")


@query(
    final(
        f"""(WITH {V.TICKS}, tr AS (SELECT seq, CASE WHEN seq % 5 <> 0 THEN symbol END AS symbol, time, price FROM ticks WHERE exchange <> 'click'),
        qu AS (SELECT CASE WHEN seq % 11 <> 0 THEN symbol END AS symbol, time, CASE WHEN seq % 3 <> 0 THEN price END AS quote,
          CASE WHEN seq % 4 <> 0 THEN size END AS quote_size FROM ticks WHERE exchange = 'click' QUALIFY row_number() OVER (PARTITION BY CASE WHEN seq % 11 <> 0 THEN symbol END, time ORDER BY seq) = 1)
        SELECT tr.seq, qu.quote, qu.quote_size FROM tr ASOF LEFT JOIN qu ON coalesce(tr.symbol, '-') = coalesce(qu.symbol, '-') AND tr.time >= qu.time)""",
        "quote",
    )
)
def as_of_nulls(spark, sf):
    """As-of join with null keys and values: the values of one row, nulls included."""
    t, seq = V.event_ticks(spark, sf), F.col("seq")
    trades = t.filter(F.col("exchange") != "click").select("seq", F.when(seq % 5 != 0, F.col("symbol")).alias("symbol"), "time", "price")
    quotes = t.filter(F.col("exchange") == "click").select(
        F.when(seq % 11 != 0, F.col("symbol")).alias("symbol"), "time", "seq",
        F.when(seq % 3 != 0, F.col("price")).alias("quote"), F.when(seq % 4 != 0, F.col("size")).alias("quote_size"),
    )
    return CX.as_of(trades, N.first_of(quotes, ["symbol", "time"], ["seq"]), ["quote", "quote_size"]).select("seq", "quote", "quote_size")


@query(
    final(
        f"""(WITH {HASHED}, base AS (SELECT hash, article_id, sentiment FROM dd),
        delta AS (SELECT hash, article_id, k, coalesce(sentiment, 0) + k AS sentiment FROM dd, range(0, 3) r(k) WHERE article_id % 2 = 0 AND k <= article_id % 3),
        last AS (SELECT hash, article_id, sentiment::DOUBLE AS sentiment FROM delta QUALIFY row_number() OVER (PARTITION BY hash ORDER BY k DESC) = 1)
        SELECT * FROM base WHERE hash NOT IN (SELECT hash FROM delta) UNION ALL SELECT * FROM last)""",
        "sentiment",
    )
)
def article_upsert_repeated(spark, sf):
    """Insert or replace with several rows per key: the last one wins."""
    base = N.dedupe_articles(_hashed(spark, sf)).select("hash", "article_id", "sentiment")
    k = F.explode(F.sequence(F.lit(0), (F.col("article_id") % 3).cast("int"))).alias("k")
    delta = base.filter("article_id % 2 = 0").select("*", k).withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)) + F.col("k"))
    return N.upsert(base, delta, ["hash"], order=["k"]).select("hash", "article_id", "sentiment")


@query(f"""WITH {V.ARTICLES}, t AS (SELECT article_id, url, concat(repeat('x', 90), article_id % 40) AS title FROM articles)
    SELECT substr(md5(concat(title, url)), 1, 16) AS hash, min(article_id) AS article_id FROM t GROUP BY 1""")
def article_long_titles(spark, sf):
    """Articles whose titles differ only after ninety characters are different articles."""
    title = F.concat(F.repeat(F.lit("x"), F.lit(90)), F.col("article_id") % 40)
    a = N.with_hash(V.articles(spark, sf).withColumn("title", title)).withColumn("source_rank", F.lit(0))
    return N.dedupe_articles(a).select("hash", "article_id")


# every tenth article has no address, every eleventh no title, so some have neither; ids beyond a million are copies
NAMELESS = f"""{V.ARTICLES}, g AS (SELECT article_id, source, published, CASE WHEN article_id % 11 <> 0 THEN title END AS title,
    CASE WHEN article_id % 10 <> 0 THEN url END AS url FROM articles),
  b AS (SELECT * FROM g UNION ALL SELECT article_id + 1000000, source, published, title, url FROM g WHERE article_id % 3 = 0),
  h AS (SELECT *, CASE WHEN title IS NOT NULL OR url IS NOT NULL THEN substr(md5(concat(coalesce(title, chr(1)), coalesce(url, chr(1)))), 1, 16) END AS hash FROM b),
  dd AS (SELECT * FROM h QUALIFY hash IS NULL OR row_number() OVER (PARTITION BY hash ORDER BY article_id) = 1)"""


def _nameless(spark, sf):
    k = F.col("article_id")
    g = V.articles(spark, sf).select("article_id", "source", "published", F.when(k % 11 != 0, F.col("title")).alias("title"), F.when(k % 10 != 0, F.col("url")).alias("url"))
    copies = g.filter(k % 3 == 0).withColumn("article_id", k + 1000000)
    return N.with_hash(g.unionByName(copies)).withColumn("source_rank", F.lit(0))


@query(f"WITH {NAMELESS} SELECT article_id, hash FROM dd")
def article_dedupe_nulls(spark, sf):
    """Articles without a title or an address are told apart by the other; those without both all stay."""
    return N.dedupe_articles(_nameless(spark, sf)).select("article_id", "hash")


@query(f"WITH {NAMELESS}, seen AS (SELECT hash FROM h WHERE published < TIMESTAMP '2024-01-02' AND hash IS NOT NULL) SELECT article_id FROM h WHERE hash IS NULL OR hash NOT IN (SELECT hash FROM seen)")
def article_new_only_nulls(spark, sf):
    """Stored articles without title or address are recognised."""
    h = _nameless(spark, sf)
    return N.new_only(h, h.filter(F.col("published") < F.lit("2024-01-02").cast("timestamp_ntz"))).select("article_id")


@query(f"""WITH {NAMELESS}, delta AS (SELECT article_id, hash, 'new' AS state FROM dd WHERE article_id % 2 = 0),
    base AS (SELECT article_id, hash, 'old' AS state FROM dd)
    SELECT * FROM base WHERE hash IS NULL OR hash NOT IN (SELECT hash FROM delta WHERE hash IS NOT NULL) UNION ALL SELECT * FROM delta""")
def article_upsert_nulls(spark, sf):
    """Articles without title or address are replaced by their hash; those without both are added."""
    base = N.dedupe_articles(_nameless(spark, sf)).select("article_id", "hash")
    delta = base.filter("article_id % 2 = 0").withColumn("state", F.lit("new"))
    return N.upsert(base.withColumn("state", F.lit("old")), delta, ["hash"])
