"""Universe, tier, taxonomy and market-context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import context as CX
from barloom.operators import samples as S
from barloom.operators import taxonomy as TX
from barloom.operators import universe as U
from barloom.operators.latest import history_span
from barloom.plans import views as V
from barloom.plans.registry import final, query
from barloom.plans.sqltext import W, chg, over

# -- tiers ---------------------------------------------------------------------------------------

TIERED = f"""{V.DAILY}, wk AS (SELECT symbol, date_trunc('week', l_shipdate) AS time, count(*) AS n, sum(size) AS volume,
   max(price) AS close FROM lines GROUP BY 1, 2),
  tb AS (SELECT symbol, time, volume * (1000 + 2000 * CAST(substr(symbol, 2) AS INTEGER)) AS volume,
    CASE WHEN symbol = 'R0' THEN close / 100000 ELSE close END AS close FROM bars
    UNION ALL SELECT symbol, time, CAST(volume AS BIGINT) * 150, close FROM wk),
  prof AS (SELECT symbol, avg(volume) AS avg_volume, avg(close) AS avg_price, arg_max(close, time) AS current_price,
    count(*) AS history_days FROM tb GROUP BY 1),
  tiers AS (SELECT *, CASE WHEN history_days <= 500 AND avg_volume >= 25000 THEN 'new_listings'
    WHEN current_price < 5 AND avg_volume >= 50000 AND history_days >= 100 THEN 'penny_stocks'
    WHEN avg_price >= 20 AND avg_volume >= 500000 AND history_days >= 1000 THEN 'blue_chip'
    WHEN avg_price >= 5 AND avg_volume >= 100000 AND history_days >= 500 THEN 'mid_cap' END AS tier FROM prof)"""


def _tiered(spark, sf):
    days = V.daily_layer(spark, sf)
    region = F.substring("symbol", 2, 9).cast("int")
    scaled = days.select(
        "symbol",
        "time",
        (F.col("volume") * (1000 + 2000 * region)).alias("volume"),
        F.when(F.col("symbol") == "R0", F.col("close") / 100000).otherwise(F.col("close")).alias("close"),
    )
    weeks = V.weekly_layer(spark, sf).select("symbol", "time", F.col("volume") * 150, F.col("high").alias("close"))
    return U.liquidity_tier(U.profile(scaled.union(weeks)))


@query(final(f"(WITH {TIERED} SELECT * FROM tiers)", "avg_volume avg_price current_price"))
def symbol_tiers(spark, sf):
    """Profile and liquidity tier per symbol."""
    return _tiered(spark, sf)


@query(f"WITH {TIERED} SELECT tier, symbol FROM tiers WHERE tier IS NOT NULL")
def tier_symbols(spark, sf):
    """Rows of the per-tier symbol lists."""
    return U.tier_symbols(_tiered(spark, sf))


@query(f"WITH {TIERED} SELECT symbol, history_days FROM tiers WHERE tier = 'mid_cap'")
def tier_filter(spark, sf):
    """Symbols of one tier."""
    return U.in_tier(_tiered(spark, sf), "mid_cap").select("symbol", "history_days")


UNIVERSE = """uni AS (SELECT s_suppkey, s_name AS symbol, r_name AS sector, (s_acctbal + 100) * pow(10, 4 + s_suppkey % 5) AS market_cap,
  s_suppkey % 3000 AS total_trading_days, s_suppkey % 7 <> 0 AS is_active FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
CAP = """CASE WHEN market_cap IS NULL OR market_cap <= 0 THEN 'unknown' WHEN market_cap >= 200e9 THEN 'mega' WHEN market_cap >= 10e9 THEN 'large'
  WHEN market_cap >= 2e9 THEN 'mid' WHEN market_cap >= 300e6 THEN 'small' WHEN market_cap >= 50e6 THEN 'micro' ELSE 'nano' END"""


def _universe(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    return (
        t("supplier")
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey",
            F.col("s_name").alias("symbol"),
            F.col("r_name").alias("sector"),
            ((F.col("s_acctbal") + 100) * F.pow(F.lit(10.0), 4 + F.col("s_suppkey") % 5)).alias("market_cap"),
            (F.col("s_suppkey") % 3000).alias("total_trading_days"),
            (F.col("s_suppkey") % 7 != 0).alias("is_active"),
        )
    )


@query(f"""WITH {UNIVERSE}, c AS (SELECT symbol, {CAP} AS tier FROM uni)
    SELECT symbol, tier, CASE tier WHEN 'unknown' THEN -1 WHEN 'nano' THEN 0 WHEN 'micro' THEN 1 WHEN 'small' THEN 2 WHEN 'mid' THEN 3
    WHEN 'large' THEN 4 ELSE 5 END AS bucket FROM c""")
def cap_tiers(spark, sf):
    """Market-cap tier and its code."""
    u = _universe(spark, sf)
    return u.select("symbol", U.cap_tier(F.col("market_cap")).alias("tier"), U.cap_bucket(F.col("market_cap")).alias("bucket"))


@query(f"WITH {UNIVERSE} SELECT symbol, sector FROM uni WHERE is_active")
def active_universe(spark, sf):
    """Active symbols."""
    return U.active(_universe(spark, sf)).select("symbol", "sector")


@query(
    final(
        f"""(WITH {UNIVERSE}, c AS (SELECT sector, {CAP} AS market_cap_tier, total_trading_days / 252 AS y FROM uni)
        SELECT sector, market_cap_tier, count(*) AS n, avg(y) AS mean_years, max(y) AS max_years FROM c
        GROUP BY ROLLUP (sector, market_cap_tier))""",
        "mean_years max_years",
    )
)
def universe_summary(spark, sf):
    """Counts and history length by sector and cap tier, with totals."""
    return U.summary(_universe(spark, sf).withColumn("market_cap_tier", U.cap_tier(F.col("market_cap"))))


TRADABLE = """tr AS (SELECT s_name AS symbol, s_suppkey, (max(s_acctbal) + 1000) * 1e6 AS market_cap, sum(l_quantity) * 40 AS avg_volume,
   avg(l_extendedprice / l_quantity) AS price, (s_suppkey % 13) / 20.0 AS spread_pct,
   CASE WHEN s_suppkey % 5 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange, s_suppkey % 11 = 0 AS is_adr
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, s_suppkey)"""


@query(
    final(
        f"""(WITH {TRADABLE} SELECT symbol, market_cap, avg_volume, price FROM tr WHERE market_cap >= 1e9 AND avg_volume >= 500000 AND price >= 5
        AND spread_pct <= 0.5 AND exchange = 'NASDAQ' AND NOT is_adr ORDER BY avg_volume DESC, symbol LIMIT 500)""",
        "market_cap avg_volume price",
    )
)
def universe_filter(spark, sf):
    """The tradable universe."""
    s = V.table(spark, sf, "supplier")
    per = V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        (F.sum("l_quantity") * 40).alias("avg_volume"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    u = per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("symbol"),
        ((F.col("s_acctbal") + 1000) * 1e6).alias("market_cap"),
        "avg_volume",
        "price",
        ((F.col("s_suppkey") % 13) / 20.0).alias("spread_pct"),
        F.when(F.col("s_suppkey") % 5 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"),
        (F.col("s_suppkey") % 11 == 0).alias("is_adr"),
    )
    return U.tradable(u, max_size=U.MAX_SIZE).select("symbol", "market_cap", "avg_volume", "price")


DIVS = """dv AS (SELECT concat('C', o_custkey) AS symbol, o_orderdate AS time, o_totalprice / 100000 AS amount FROM orders),
  px AS (SELECT concat('C', c_custkey) AS symbol, c_acctbal / 10 AS close FROM customer),
  lastd AS (SELECT symbol, max(time) AS l FROM dv GROUP BY 1),
  yr AS (SELECT symbol, sum(amount) AS year_sum FROM dv JOIN lastd USING (symbol) WHERE time > l - INTERVAL 1 YEAR GROUP BY 1),
  divi AS (SELECT symbol, coalesce(year_sum, 0) AS year_sum, coalesce(year_sum, 0) > 0 AS has_dividend,
    CASE WHEN close > 0 THEN round(coalesce(year_sum, 0) / close * 100, 2) ELSE 0 END AS dividend_yield FROM px LEFT JOIN yr USING (symbol))"""


def _dividends(spark, sf):
    o = V.table(spark, sf, "orders")
    div = o.select(
        F.concat(F.lit("C"), "o_custkey").alias("symbol"),
        F.col("o_orderdate").alias("time"),
        (F.col("o_totalprice") / 100000).alias("amount"),
    )
    px = V.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("symbol"), (F.col("c_acctbal") / 10).alias("close")
    )
    return U.dividends(div, px)


@query(final(f"(WITH {DIVS} SELECT * FROM divi)", "year_sum dividend_yield"))
def dividend_yield(spark, sf):
    """Trailing-year dividends and yield."""
    return _dividends(spark, sf)


@query(final(f"(WITH {DIVS} SELECT symbol, dividend_yield FROM divi ORDER BY dividend_yield DESC, symbol LIMIT 10)", "dividend_yield"))
def top_dividend_payers(spark, sf):
    """The ten highest yields."""
    return U.top_payers(_dividends(spark, sf)).select("symbol", "dividend_yield")


@query(f"""WITH {DIVS} SELECT CASE WHEN hash_ = 0 THEN NULL ELSE concat('t', hash_) END AS tier, count(*) AS n,
    CAST(sum(CASE WHEN has_dividend THEN 1 ELSE 0 END) AS BIGINT) AS dividend_payers
    FROM (SELECT *, CAST(substr(symbol, 2) AS INTEGER) % 4 AS hash_ FROM divi) GROUP BY 1""")
def tier_dividend_counts(spark, sf):
    """Symbols and dividend payers per tier."""
    k = F.substring("symbol", 2, 12).cast("int") % 4
    return U.tier_counts(_dividends(spark, sf).withColumn("tier", F.when(k != 0, F.concat(F.lit("t"), k))))


@query(f"""WITH {V.DAILY} SELECT symbol, count(*) AS n_rows FROM bars GROUP BY 1 HAVING count(*) > 1000
    ORDER BY 2 DESC, 1 LIMIT 10""")
def longest_histories(spark, sf):
    """The ten longest histories."""
    as_of = V.table(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("as_of"))
    return U.longest_histories(history_span(V.daily_layer(spark, sf), as_of)).select("symbol", "n_rows")


@query("""SELECT symbol FROM (SELECT upper(substr(c_mktsegment, 1 + c_custkey % 3, 1 + c_custkey % 7)) AS symbol FROM customer)
    WHERE regexp_full_match(symbol, '[A-Z]+') AND length(symbol) <= 5""")
def plain_symbols(spark, sf):
    """Letters-only symbols of at most five characters."""
    k = F.col("c_custkey")
    raw = V.table(spark, sf, "customer").select(
        F.upper(F.substring(F.col("c_mktsegment"), (1 + k % 3).cast("int"), (1 + k % 7).cast("int"))).alias("symbol")
    )
    return U.plain_symbols(raw)


# -- taxonomy ------------------------------------------------------------------------------------

# Industry texts a supplier may carry: aliases, exact names, near names, blanks, unknown.
PROBES = (
    "Software—Application", "Semiconductors", "Biotech", "REIT—Mortgage", "regional Banks", "", "Gold", "Quantum stuff",
    "  Airlines  ", "Media", "Oil & Gas Midstream", "Wireless Telecom Services", "Insurance—Life", "Retail", "Machinery",
    "Power", "Hotels & Restaurants", "Tobacco", "x",
)
SECTOR_PROBES = ("Technology", "healthcare", "", "Utility", "Basic Materials", "Unknown sector", "FINANCE", "Energy", "reit", "Media", "Telecommunications")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) v({names})"


TAX = f"""probe AS (SELECT s_name AS symbol, [{", ".join(_q(p) for p in PROBES)}][1 + s_suppkey % {len(PROBES)}] AS industry,
   [{", ".join(_q(p) for p in SECTOR_PROBES)}][1 + s_suppkey % {len(SECTOR_PROBES)}] AS sector FROM supplier),
  ind AS (SELECT * FROM {_values([(i, n, s) for i, (n, s) in enumerate(TX.INDUSTRIES)], "id, name, sector")}),
  ali AS (SELECT * FROM {_values(list(TX.INDUSTRY_ALIASES.items()), "name, id")}),
  sec AS (SELECT * FROM {_values([(x.lower(), i) for i, (n, o) in TX.SECTORS.items() for x in (n, *o)], "name, id")}),
  secname AS (SELECT * FROM {_values([(i, n) for i, (n, _) in TX.SECTORS.items()], "id, name")}),
  t AS (SELECT *, lower(trim(industry)) AS li, lower(trim(sector)) AS ls FROM probe),
  t2 AS (SELECT symbol, industry, sector, coalesce((SELECT id FROM sec WHERE name = ls), -1) AS sid,
    CASE WHEN industry = '' THEN -1 ELSE coalesce((SELECT id FROM ali WHERE name = li), (SELECT id FROM ind WHERE lower(name) = li),
      (SELECT min(id) FROM ind WHERE contains(li, lower(name)) OR contains(lower(name), li)), -1) END AS industry_id FROM t),
  cls AS (SELECT symbol, industry_id, CASE WHEN sid < 0 AND industry_id >= 0 THEN (SELECT sector FROM ind WHERE id = industry_id) ELSE sid END AS sector_id,
    CASE WHEN sid < 0 AND industry_id >= 0 THEN (SELECT s.name FROM ind JOIN secname s ON s.id = ind.sector WHERE ind.id = industry_id)
         WHEN sector = '' THEN 'Unknown' ELSE sector END AS sector_name,
    CASE WHEN industry = '' THEN 'Unknown' ELSE industry END AS industry_name FROM t2)"""


def _probes(spark, sf):
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (1 + F.col("s_suppkey") % len(xs)).cast("int"))
    return V.table(spark, sf, "supplier").select(
        F.col("s_name").alias("symbol"), pick(PROBES).alias("industry"), pick(SECTOR_PROBES).alias("sector"), "s_acctbal"
    )


@query(f"WITH {TAX} SELECT symbol, sector_id, sector_name FROM cls")
def sector_classify(spark, sf):
    """Sector id and name, repaired from the industry where the sector is unknown."""
    return TX.classify(_probes(spark, sf)).select("symbol", "sector_id", "sector_name")


@query(f"WITH {TAX} SELECT symbol, industry_id, industry_name FROM cls")
def industry_fuzzy(spark, sf):
    """Industry id by alias, exact name or the first name that overlaps."""
    return TX.classify(_probes(spark, sf)).select("symbol", "industry_id", "industry_name")


@query(f"WITH {TAX} SELECT symbol, sector_id, industry_id FROM cls")
def classify_uncached(spark, sf):
    """Only symbols without an earlier classification are classified; both parts come back."""
    p = _probes(spark, sf)
    known = TX.classify(p.filter(F.col("s_acctbal") > 5000))
    return TX.classify_new(p, known).select("symbol", "sector_id", "industry_id")


@query(f"""WITH {TAX} SELECT p.symbol, coalesce(h.id, -1) AS sector_id FROM probe p LEFT JOIN
    (SELECT * FROM {_values(list(TX.HISTORY_SECTORS.items()), "name, id")}) h ON h.name = p.sector""")
def sector_history_style(spark, sf):
    """Sector id by exact spelling."""
    return TX.with_sector_id(_probes(spark, sf), style="history").select("symbol", "sector_id")


@query(f"""WITH {TAX} SELECT 'sector' AS kind, symbol FROM cls WHERE sector_id = 2
    UNION ALL SELECT 'industry', symbol FROM cls WHERE industry_id = 27""")
def peer_symbols(spark, sf):
    """Symbols of one sector and of one industry."""
    c = TX.classify(_probes(spark, sf))
    a = TX.sector_stocks(c, 2).select(F.lit("sector").alias("kind"), "symbol")
    return a.union(TX.industry_stocks(c, 27).select(F.lit("industry").alias("kind"), "symbol"))


_NAMES = sorted({s for p in TX.PAIRS for s in p})


@query(f"""WITH own AS (SELECT s_suppkey, [{", ".join(_q(n) for n in _NAMES)}][1 + s_suppkey % {len(_NAMES)}] AS symbol FROM supplier),
    e AS (SELECT a, b FROM {_values(TX.PAIRS, "a, b")} UNION SELECT b, a FROM {_values(TX.PAIRS, "a, b")})
    SELECT s_suppkey, symbol, b AS related FROM own JOIN e ON symbol = a""")
def peer_pairs(spark, sf):
    """Related symbols over the symmetric pair list."""
    own = V.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (1 + F.col("s_suppkey") % len(_NAMES)).cast("int")).alias("symbol"),
    )
    return TX.related_symbols(own).select("s_suppkey", "symbol", "related")


@query(f"""WITH {TAX}, a AS (SELECT * FROM {_values([(i, n[0], len(n)) for i, n in TX.ANCHORS.items()], "id, lead_symbol, n")})
    SELECT symbol, sector_id, lead_symbol, n AS n_anchors, (CASE WHEN sector_id = 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS is_third
    FROM cls LEFT JOIN a ON a.id = sector_id""")
def sector_anchors(spark, sf):
    """Anchor symbols of each symbol's sector, and the one-hot sector."""
    df = TX.one_hot_sector(TX.sector_anchors(TX.classify(_probes(spark, sf))))
    return df.select(
        "symbol",
        "sector_id",
        F.col("anchors")[0].alias("lead_symbol"),
        F.when(F.col("anchors").isNotNull(), F.size("anchors")).alias("n_anchors"),
        F.col("sector_onehot")[3].alias("is_third"),
    )


@query(f"""WITH m AS (SELECT * FROM {_values(TX.MAJOR_DELISTINGS, "symbol, company_name, delist_reason, delist_year")}),
    own AS (SELECT o_orderkey, [{", ".join(_q(r[0]) for r in TX.MAJOR_DELISTINGS)}, 'NONE'][1 + o_orderkey % 18] AS symbol, year(o_orderdate) AS y FROM orders)
    SELECT symbol, company_name, delist_reason, count(*) AS n, CAST(sum(CASE WHEN y > delist_year THEN 1 ELSE 0 END) AS BIGINT) AS n_after
    FROM own JOIN m USING (symbol) GROUP BY 1, 2, 3""")
def known_delistings(spark, sf):
    """Orders in symbols of the known delisting list."""
    names = [r[0] for r in TX.MAJOR_DELISTINGS] + ["NONE"]
    o = V.table(spark, sf, "orders").select(
        F.element_at(F.array(*(F.lit(n) for n in names)), (1 + F.col("o_orderkey") % 18).cast("int")).alias("symbol"),
        F.year("o_orderdate").alias("y"),
    )
    both = o.join(F.broadcast(TX.delisting_list(spark)), "symbol")
    return both.groupBy("symbol", "company_name", "delist_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > F.col("delist_year")).cast("long")).alias("n_after")
    )


# -- market context ------------------------------------------------------------------------------

REGIONS = ("R0", "R1", "R2", "R3", "R4")
CONTEXT = f"""{V.DAILY}, cx AS (SELECT time, {", ".join(f"max(CASE WHEN symbol = '{r}' THEN close END) AS {r}_close" for r in REGIONS)} FROM bars GROUP BY 1),
  ff AS (SELECT time, {", ".join(f"last_value({r}_close IGNORE NULLS) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS {r}_close" for r in REGIONS)} FROM cx)"""
CLOSES = " ".join(f"{r}_close" for r in REGIONS)


@query(final(f"(WITH {CONTEXT} SELECT * FROM ff)", CLOSES))
def market_context_ffill(spark, sf):
    """Several series side by side on the union of their dates, forward-filled."""
    return CX.market_context(V.daily_layer(spark, sf), REGIONS)


@query(
    final(
        f"""(WITH {CONTEXT}, wb AS (SELECT symbol, date_trunc('week', l_shipdate) AS time, max(price) AS close FROM lines GROUP BY 1, 2),
        {V.ARTICLES}, se AS (SELECT symbol, date_trunc('week', published) - INTERVAL 5 YEAR AS d, avg(sentiment) AS avg_sentiment FROM articles GROUP BY 1, 2),
        se2 AS (SELECT symbol, date_trunc('week', d) AS time, avg(avg_sentiment) AS avg_sentiment FROM se GROUP BY 1, 2),
        j AS (SELECT wb.symbol, wb.time, wb.close, R0_close, R3_close, coalesce(avg_sentiment, 0) AS avg_sentiment
          FROM wb LEFT JOIN ff ON ff.time = wb.time LEFT JOIN se2 ON se2.symbol = wb.symbol AND se2.time = wb.time)
        SELECT symbol, time, close, last_value(R0_close IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS R0_close,
        last_value(R3_close IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS R3_close, avg_sentiment FROM j)""",
        "close R0_close R3_close avg_sentiment",
    )
)
def training_join(spark, sf):
    """Bars with market context and sentiment: missing sentiment is neutral, missing context carried forward."""
    context = CX.market_context(V.daily_layer(spark, sf), REGIONS)
    bars = V.weekly_layer(spark, sf).select("symbol", "time", F.col("high").alias("close"))
    a = V.articles(spark, sf).groupBy("symbol", F.date_trunc("week", "published").alias("w")).agg(F.avg("sentiment").alias("s"))
    time = F.date_trunc("week", F.col("w").cast("timestamp_ntz") - F.make_ym_interval(F.lit(5))).cast("timestamp_ntz")
    sentiment = a.groupBy("symbol", time.alias("time")).agg(F.avg("s").alias("avg_sentiment"))
    df = CX.training_features(bars, context, sentiment)
    return df.select("symbol", "time", "close", "R0_close", "R3_close", "avg_sentiment")


@query(
    final(
        f"""(WITH {V.TICKS}, tr AS (SELECT * FROM ticks WHERE exchange <> 'click'), qu AS (SELECT symbol, time, price AS quote, size AS quote_size FROM ticks WHERE exchange = 'click')
        SELECT tr.seq, tr.symbol, tr.price, qu.quote, qu.quote_size FROM tr ASOF LEFT JOIN qu ON tr.symbol = qu.symbol AND tr.time >= qu.time)""",
        "price quote",
    )
)
def as_of_join(spark, sf):
    """Every other event with the newest click of its user at or before it."""
    t = V.event_ticks(spark, sf)
    trades = t.filter(F.col("exchange") != "click").select("seq", "symbol", "time", "price")
    quotes = t.filter(F.col("exchange") == "click").select("symbol", "time", F.col("price").alias("quote"), F.col("size").alias("quote_size"))
    return CX.as_of(trades, quotes, ["quote", "quote_size"]).select("seq", "symbol", "price", "quote", "quote_size")
