"""News, knowledge-graph and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import pct
from barloom.functions.series import Series
from barloom.operators import news as N
from barloom.operators import proxy as P
from barloom.operators import scoring as SC
from barloom.operators import taxonomy as TX
from barloom.plans import views as V
from barloom.plans.q_reference import _q, _values
from barloom.plans.registry import final, query
from barloom.plans.sqltext import W, chg, lag, over, roll
from barloom.sources import graph_records as G
from barloom.sources.stage import new_path

HASHED = f"""{V.ARTICLES}, h AS (SELECT *, substr(md5(concat(title, url)), 1, 16) AS hash,
  list_position(['reuters', 'bloomberg', 'wsj', 'cnbc', 'benzinga', 'seekingalpha', 'motleyfool', 'unknown'], source) AS source_rank FROM articles),
  dd AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY source_rank, article_id) = 1)"""


def _hashed(spark, sf):
    names = F.array(*(F.lit(s) for s in V.SOURCE_NAMES))
    return N.with_hash(V.articles(spark, sf)).withColumn("source_rank", F.array_position(names, F.col("source")))


@query(f"WITH {HASHED} SELECT hash, article_id, source, symbol FROM dd")
def article_dedupe(spark, sf):
    """One article per hash; the first source wins."""
    return N.dedupe_articles(_hashed(spark, sf)).select("hash", "article_id", "source", "symbol")


@query(f"WITH {HASHED} SELECT source, count(*) AS n, min(article_id) AS first_id FROM h GROUP BY 1")
def source_fan_in(spark, sf):
    """Several landed sources as one table: a folder for each, with different columns."""
    path = new_path(spark, "sources")
    V.articles(spark, sf).withColumn("name", F.col("source")).write.partitionBy("name").parquet(path)
    landed = V.articles(spark, sf).schema
    parts = [spark.read.schema(landed).parquet(f"{path}/name={s}").drop("confidence" if i else "url") for i, s in enumerate(V.SOURCE_NAMES)]
    return N.fan_in(*parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id"))


@query(f"WITH {HASHED} SELECT article_id FROM dd WHERE hash NOT IN (SELECT hash FROM h WHERE published < TIMESTAMP '2024-01-02')")
def article_new_only(spark, sf):
    """Articles whose hash was not stored on the first day."""
    h = _hashed(spark, sf)
    seen = h.filter(F.col("published") < F.lit("2024-01-02").cast("timestamp_ntz")).select("hash").distinct()
    return N.new_only(N.dedupe_articles(h), seen).select("article_id")


@query(
    final(
        f"""(WITH {HASHED}, base AS (SELECT hash, article_id, sentiment FROM dd),
        delta AS (SELECT hash, article_id, coalesce(sentiment, 0) * 0.5::DOUBLE AS sentiment FROM dd WHERE published >= TIMESTAMP '2024-01-03')
        SELECT * FROM base WHERE hash NOT IN (SELECT hash FROM delta) UNION ALL SELECT * FROM delta)""",
        "sentiment",
    )
)
def article_upsert(spark, sf):
    """Insert or replace by hash."""
    base = N.dedupe_articles(_hashed(spark, sf)).select("hash", "article_id", "sentiment", "published")
    delta = base.filter(F.col("published") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    delta = delta.withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)) * 0.5)
    return N.upsert(base, delta, ["hash"]).select("hash", "article_id", "sentiment")


@query(
    final(
        f"""(WITH {V.ARTICLES} SELECT article_id, published, sentiment FROM articles WHERE symbol = 'NATION_4'
        AND published BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-06')""",
        "sentiment",
    )
)
def articles_for_symbol(spark, sf):
    """Articles of a symbol in a date range, newest first."""
    df = N.in_range(V.articles(spark, sf), "NATION_4", "2024-01-02", "2024-01-06")
    return df.select("article_id", "published", "sentiment")


DAYS = f"""{V.ARTICLES}, days AS (SELECT symbol, CAST(published AS DATE) AS date, avg(sentiment) AS avg_sentiment,
  CASE WHEN count(*) > 1 THEN stddev_pop(sentiment) ELSE 0 END AS sentiment_std, count(*) AS article_count
  FROM articles WHERE sentiment IS NOT NULL GROUP BY 1, 2)"""


@query(final(f"(WITH {DAYS} SELECT * FROM days)", "avg_sentiment sentiment_std"))
def daily_sentiment(spark, sf):
    """Daily mean, deviation and count of scored articles."""
    return N.daily_sentiment(V.articles(spark, sf)).drop("source_breakdown")


@query(final(f"(WITH {DAYS} SELECT date, avg_sentiment, article_count FROM days WHERE symbol = 'NATION_4' AND date BETWEEN DATE '2024-01-02' AND DATE '2024-01-06')", "avg_sentiment"))
def daily_sentiment_range(spark, sf):
    """Daily sentiment of a symbol in a date range."""
    d = N.daily_range(N.daily_sentiment(V.articles(spark, sf)), "NATION_4", "2024-01-02", "2024-01-06")
    return d.select("date", "avg_sentiment", "article_count")


@query(
    final(
        f"""(WITH {V.ARTICLES} SELECT symbol, CAST(published AS DATE) AS date, source, avg(sentiment) AS source_mean FROM articles
        WHERE sentiment IS NOT NULL GROUP BY 1, 2, 3)""",
        "source_mean",
    )
)
def source_breakdown(spark, sf):
    """The per-source means of the daily map, one row per entry."""
    d = N.daily_sentiment(V.articles(spark, sf))
    return d.select("symbol", "date", F.explode("source_breakdown").alias("source", "source_mean"))


@query(
    final(
        f"""(WITH {V.ARTICLES}, t AS (SELECT CAST(published AS DATE) AS date, symbol AS ticker, (article_id * 7) % 41 - 20.0::DOUBLE AS tone,
          coalesce(sentiment, ((article_id * 7) % 41 - 20) / 100.0::DOUBLE) AS score, CASE WHEN sentiment IS NULL THEN 0.3::DOUBLE ELSE confidence END AS conf FROM articles)
        SELECT date, ticker, count(*) AS article_count, avg(tone) AS avg_tone, stddev_samp(tone) AS tone_std, avg(score) AS avg_score,
        stddev_samp(score) AS score_std, avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END) AS bullish_ratio,
        avg(CASE WHEN score < -0.1 THEN 1.0 ELSE 0.0 END) AS bearish_ratio FROM t GROUP BY 1, 2)""",
        "avg_tone tone_std avg_score score_std bullish_ratio bearish_ratio",
    )
)
def ticker_sentiment(spark, sf):
    """Daily ticker sentiment with the tone as fallback score."""
    a = V.articles(spark, sf).withColumn("tone", ((F.col("article_id") * 7) % 41 - 20).cast("double"))
    a = a.withColumns(N.fallback_score(F.col("sentiment"), F.col("confidence"), F.col("tone")))
    return N.ticker_sentiment(
        a.select(F.to_date("published").alias("date"), F.col("symbol").alias("ticker"), "tone", "score"), score="score"
    )


WEIGHTS = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in N.SOURCE_WEIGHTS.items()) + ") sw(source, weight)"


@query(
    final(
        f"""(WITH {V.ARTICLES}, g AS (SELECT DISTINCT CASE WHEN published = date_trunc('day', published) THEN published
             ELSE date_trunc('day', published) + INTERVAL 1 DAY END AS time FROM articles),
        x AS (SELECT symbol, time, sentiment, title, sentiment * wt AS sw, wt FROM (
           SELECT a.symbol, g.time, a.sentiment, a.title, exp(-epoch(g.time - a.published) / 21600.0) * weight * confidence AS wt
           FROM articles a JOIN g ON a.published <= g.time AND a.published > g.time - INTERVAL 24 HOUR
           JOIN (SELECT * FROM {WEIGHTS}) s ON s.source = a.source WHERE a.sentiment IS NOT NULL)),
        d AS (SELECT symbol, time, sum(sw) / sum(wt) AS weighted_sentiment, count(*) AS article_count, arg_max(title, abs(sw)) AS top_headline
              FROM x GROUP BY 1, 2)
        SELECT *, weighted_sentiment - {lag('weighted_sentiment')} AS sentiment_momentum,
        (article_count - ({roll('avg', 'article_count', 20)})) / (({roll('stddev_samp', 'article_count', 20)}) + 1e-8) AS attention_score FROM d)""",
        "weighted_sentiment sentiment_momentum attention_score",
    )
)
def decayed_sentiment(spark, sf):
    """Decayed, credibility-weighted sentiment on a daily grid, with momentum, attention and headline."""
    return N.decayed_sentiment(V.articles(spark, sf))


@query(
    final(
        """(WITH p AS (SELECT doc_id, (1 + doc_id % 5)::DOUBLE AS a, (1 + doc_id % 7)::DOUBLE AS b, (1 + doc_id % 3)::DOUBLE AS c FROM documents),
        q AS (SELECT doc_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM p)
        SELECT doc_id, c - a AS score, greatest(a, b, c) AS confidence,
        CASE WHEN c >= a AND c >= b THEN 'bullish' WHEN a >= b THEN 'bearish' ELSE 'neutral' END AS label FROM q)""",
        "score confidence",
    )
)
def probability_scores(spark, sf):
    """Score, confidence and label from class probabilities."""
    k = F.col("doc_id")
    a, b, c = ((1 + k % m).cast("double") for m in (5, 7, 3))
    t = a + b + c
    return V.table(spark, sf, "documents").select("doc_id", *(x.alias(n) for n, x in N.from_probabilities(a / t, b / t, c / t).items()))


# -- knowledge-graph records -------------------------------------------------------------------

GRAPH_THEMES = ("ECON_STOCK;WB_1", "health;SPORT", "", "quarterly_earnings", "tax_fncact;", "CRISISLEX", "Merger talks", "WB_678")
GRAPH_ORGS = (
    "Apple Inc;Google", "Nvidia Corp;apple", "", " Tesla ;Unknown Llc", "Intel;Intel Corp;AMD", "city council", "Netflix;Meta",
    "amazon.com", ";Microsoft", "Alphabet", "some ministry",
)


def _graph_lines(spark, sf):
    """Documents as raw 27-column lines, some of them malformed."""
    k = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (1 + k % len(xs)).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")), "yyyyMMdd")
    date = F.when(k % 41 == 0, "2024-13-77").otherwise(F.concat(day, F.lit("093000")))
    value = (((k * 7) % 41 - 20) / 2).cast("decimal(6,1)").cast("string")
    tone = (
        F.when(k % 37 == 0, "n/a")
        .when(k % 29 == 0, value)
        .when(k % 31 == 0, "")
        .otherwise(F.concat_ws(",", value, F.lit("1"), F.lit("2"), F.lit("3"), F.col("n_chars").cast("string"), F.lit("9")))
    )
    empty = F.lit("")
    fields = [F.concat(F.lit("r"), k), date, F.lit("1"), F.col("source"), F.concat(F.lit("http://n.example/"), k), empty, empty,
              pick(GRAPH_THEMES), empty, F.lit("1#Paris;"), empty, F.lit("Jane Doe;"), empty, pick(GRAPH_ORGS), empty, tone]
    fields += [empty] * (27 - len(fields))
    line = F.concat_ws("\t", *fields)
    line = F.when(k % 43 == 0, F.concat(line, F.lit("\textra\tfields"))).otherwise(line)
    return V.table(spark, sf, "documents").select(k, line.alias("value"))


def _list(xs):
    return "[" + ", ".join(_q(x) for x in xs) + f"][1 + doc_id % {len(xs)}]"


GRAPH = f"""g0 AS (SELECT doc_id, source, n_chars, concat('http://n.example/', doc_id) AS url, {_list(GRAPH_THEMES)} AS th, {_list(GRAPH_ORGS)} AS og,
   DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS date, ((doc_id * 7) % 41 - 20) / 2.0::DOUBLE AS tv FROM documents),
  g1 AS (SELECT doc_id, date, url, source, CASE WHEN doc_id % 29 <> 0 AND doc_id % 31 = 0 THEN NULL ELSE tv END AS tone,
    CASE WHEN th = '' THEN [] ELSE string_split(th, ';') END AS themes,
    list_filter(list_transform(string_split(og, ';'), lambda o: lower(o)), lambda o: o <> '') AS organizations,
    CASE WHEN doc_id % 29 = 0 OR doc_id % 31 = 0 THEN 0 ELSE n_chars END::INTEGER AS word_count
    FROM g0 WHERE doc_id % 41 <> 0 AND doc_id % 37 <> 0 AND doc_id % 43 <> 0),
  rel AS (SELECT * FROM g1 WHERE len(list_filter(themes, lambda t: regexp_matches(upper(t), '{"|".join(G.THEME_TOKENS)}'))) > 0),
  co AS (SELECT * FROM {_values(list(TX.COMPANIES.items()), "name, ticker")}),
  men AS (SELECT DISTINCT doc_id, date, url, source, tone, word_count, ticker FROM (SELECT *, unnest(organizations) AS org FROM rel) x
    JOIN co ON co.name = trim(x.org))"""


@query(
    final(
        f"""(WITH {GRAPH} SELECT doc_id, date, url, source, tone, len(themes)::INTEGER AS n_themes, array_to_string(organizations, '|') AS orgs,
        'jane doe' AS persons, word_count FROM g1)""",
        "tone",
    )
)
def graph_parse(spark, sf):
    """Knowledge-graph lines parsed; malformed records dropped."""
    return G.parse_lines(_graph_lines(spark, sf)).select(
        "doc_id",
        "date",
        "url",
        "source",
        "tone",
        F.size("themes").alias("n_themes"),
        F.array_join("organizations", "|").alias("orgs"),
        F.array_join("persons", "|").alias("persons"),
        "word_count",
    )


@query(f"""WITH {GRAPH} SELECT doc_id FROM rel UNION SELECT doc_id FROM (SELECT doc_id, unnest(organizations) AS org FROM g1) x
    JOIN co ON co.name = trim(x.org) WHERE ticker IN ('NFLX', 'AMZN')""")
def stock_relevant(spark, sf):
    """Records with a market theme or a mention of the wanted symbols."""
    return G.market_relevant(G.parse_lines(_graph_lines(spark, sf)), ["NFLX", "AMZN"]).select("doc_id")


@query(final(f"(WITH {GRAPH} SELECT doc_id, date, ticker, tone, word_count FROM men)", "tone"))
def ticker_mentions(spark, sf):
    """One row per record and distinct ticker."""
    rel = G.market_relevant(G.parse_lines(_graph_lines(spark, sf)))
    return G.mentions(rel).select("doc_id", "date", "ticker", "tone", "word_count")


@query(
    final(
        f"""(WITH {GRAPH} SELECT date, ticker, count(*) AS article_count, avg(tone) AS avg_tone, stddev_samp(tone) AS tone_std,
        avg(CASE WHEN tone > 0.1 THEN 1.0 WHEN tone IS NOT NULL THEN 0.0 END) AS bullish_ratio,
        avg(CASE WHEN tone < -0.1 THEN 1.0 WHEN tone IS NOT NULL THEN 0.0 END) AS bearish_ratio FROM men GROUP BY 1, 2)""",
        "avg_tone tone_std bullish_ratio bearish_ratio",
    )
)
def graph_sentiment_by_day(spark, sf):
    """From raw lines to daily ticker sentiment."""
    return G.sentiment_by_day(_graph_lines(spark, sf)).drop("avg_score", "score_std")


@query(
    final(
        f"""(WITH {GRAPH}, d AS (SELECT date, ticker, count(*) AS c, avg(tone) AS t FROM men GROUP BY 1, 2)
        SELECT ticker, CAST(sum(c) AS BIGINT) AS article_count, avg(t) AS avg_tone FROM d GROUP BY 1)""",
        "avg_tone",
    )
)
def ticker_totals(spark, sf):
    """Daily ticker sentiment rolled up per ticker."""
    return N.ticker_totals(G.sentiment_by_day(_graph_lines(spark, sf)))


@query(f"WITH {GRAPH} SELECT doc_id, date FROM g1 WHERE date >= DATE '2024-01-11'")
def graph_new_days(spark, sf):
    """Records of days that are not stored yet."""
    r = G.parse_lines(_graph_lines(spark, sf))
    stored = r.filter(F.col("date") < F.lit("2024-01-11").cast("date"))
    return G.new_days(r, stored).select("doc_id", "date")


@query(
    final(
        f"""(WITH {V.WEEKLY}, {V.ARTICLES}, nw AS (SELECT CAST(published AS DATE) AS date, symbol AS ticker, count(*) AS article_count, avg(sentiment) AS avg_tone
           FROM articles GROUP BY 1, 2)
        SELECT date, ticker, article_count, avg_tone, 'news' AS source FROM nw WHERE date >= DATE '2000-01-01'
        UNION ALL SELECT CAST(time AS DATE), symbol, 0, 0.0, 'price_proxy' FROM bars WHERE time < TIMESTAMP '2000-01-01')""",
        "avg_tone",
    )
)
def sentiment_history(spark, sf):
    """News sentiment from a start day on, price-derived sentiment before."""
    a = V.articles(spark, sf)
    news = a.groupBy(F.to_date("published").alias("date"), F.col("symbol").alias("ticker")).agg(
        F.count(F.lit(1)).alias("article_count"), F.avg("sentiment").alias("avg_tone")
    )
    out = P.sentiment_history(news, V.weekly_layer(spark, sf), start="2000-01-01")
    return out.select("date", "ticker", "article_count", "avg_tone", "source")


# -- scoring -----------------------------------------------------------------------------------


def length_scorer():
    """A stand-in for a language model: the reply depends on the whole text's length."""

    def score(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            n = len(t)
            if n % 13 == 0:
                out.append("I cannot rate this.")
            elif n % 17 == 0:
                out.append('Rating: {"sentiment_score": oops}')
            else:
                out.append(f'Rating: {{"sentiment_score": {(n % 31 - 15) / 10}, "reasoning": "length {n}"}} done')
        return out

    return score


@query(
    final(
        """(WITH n AS (SELECT doc_id, length(text) AS n FROM documents)
        SELECT doc_id, CASE WHEN n % 13 > 0 AND n % 17 > 0 THEN greatest(-1, least(1, (n % 31 - 15) / 10.0))::DOUBLE END AS sentiment,
        CASE WHEN n % 13 > 0 AND n % 17 > 0 THEN 0.5::DOUBLE END AS confidence,
        CASE WHEN n % 13 > 0 AND n % 17 > 0 THEN concat('length ', n) END AS reasoning FROM n)""",
        "sentiment confidence",
    )
)
def text_scoring(spark, sf):
    """Whole texts scored by a plug-in; its replies are parsed, clamped and given defaults."""
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    return SC.score_texts(d, length_scorer).select("doc_id", "sentiment", "confidence", "reasoning")


def linear_predictor():
    import numpy as np

    weights = np.array([0.002, -0.001])

    def predict(x):
        return x @ weights

    return predict


@query(
    final(
        f"""(WITH {V.WEEKLY}, f AS (SELECT symbol, time, {chg('close')} AS a, {chg('volume')} AS b FROM bars),
        p AS (SELECT symbol, time, 0.002::DOUBLE * a - 0.001::DOUBLE * b AS r FROM f WHERE a IS NOT NULL)
        SELECT symbol, time, r AS predicted_return, CASE WHEN r > 0.01 THEN 1 WHEN r < -0.01 THEN -1 ELSE 0 END AS direction,
        CASE WHEN r > 0.01 THEN 'BUY' WHEN r < -0.01 THEN 'SELL' ELSE 'HOLD' END AS signal, least(1.0, abs(r) / 0.05) AS confidence FROM p)""",
        "predicted_return confidence",
    )
)
def batch_scoring(spark, sf):
    """Feature vectors scored in batches by a plug-in model, then turned into signals."""
    s = Series.of(V.weekly_layer(spark, sf), behind=1)
    s = s.with_columns(_c=s.back("close"), _v=s.back("volume"))
    f = s.own().filter(F.col("_c").isNotNull())
    f = f.select("symbol", "time", pct(F.col("close"), F.col("_c")).alias("a"), pct(F.col("volume"), F.col("_v")).alias("b"))
    p = SC.score_vectors(f, linear_predictor, ["a", "b"])
    return p.withColumns(SC.prediction_signal(F.col("predicted_return"))).drop("a", "b")


def sum_predictor():
    def predict(x):
        return x.sum(axis=(1, 2))

    return predict


@query(
    final(
        f"""(WITH {V.WEEKLY}, c AS (SELECT *, row_number() OVER ({W}) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
        SELECT symbol, time, s AS predicted_return FROM (SELECT *, sum(close + volume) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM c)
        WHERE t >= 9 AND t + 3 <= n - 1)""",
        "predicted_return",
    )
)
def sequence_scoring(spark, sf):
    """Sequence samples scored by a plug-in model."""
    from barloom.operators.samples import windows

    x = windows(V.weekly_layer(spark, sf), ["close", "volume"], 10, 2)
    return SC.score_sequences(x, sum_predictor, (10, 2)).select("symbol", "time", "predicted_return")


@query(
    final(
        f"""(WITH {V.WEEKLY}, f AS (SELECT symbol, time, {chg('close')} AS a, {over('lead(close, 1)')} / close - 1 AS y FROM bars),
        g AS (SELECT regr_slope(y, a) AS b1, regr_intercept(y, a) AS b0 FROM f WHERE a IS NOT NULL AND y IS NOT NULL)
        SELECT symbol, time, b0 + b1 * a AS predicted_return FROM f, g WHERE a IS NOT NULL)""",
        "predicted_return",
    )
)
def return_model(spark, sf):
    """A linear return model fitted and applied."""
    s = Series.of(V.weekly_layer(spark, sf), behind=1, ahead=1)
    s = s.with_columns(_c=s.back("close"), _n=s.ahead("close"))
    f = s.own().select(
        "symbol", "time", pct(F.col("close"), F.col("_c")).alias("a"), (F.col("_n") / F.col("close") - 1).alias("y")
    )
    model = SC.fit_return_model(f, ["a"], "y")
    return SC.predict_return(model, f, ["a"]).select("symbol", "time", "predicted_return")
