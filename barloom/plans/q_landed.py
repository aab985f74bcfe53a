"""Files written to the shared folder in the vendors' formats and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import families as FA
from barloom.operators import scoring as SC
from barloom.operators import universe as U
from barloom.plans import views as V
from barloom.plans.q_reference import CAP
from barloom.plans.q_signals import factors
from barloom.plans.registry import final, query
from barloom.sources import barstore as BS
from barloom.sources import graph_records as G
from barloom.sources import landed as LD
from barloom.sources import messages as MS
from barloom.sources.stage import new_path


@query(final(f"""(WITH {V.WEEKLY} SELECT symbol, time AS "timestamp", open, close, volume::DOUBLE AS volume, trade_count AS transactions FROM bars)""", "open close volume"))
def aggregate_files(spark, sf):
    """Vendor aggregate files, one document of at most 50 results each, written and read back."""
    b, path = V.weekly_layer(spark, sf), new_path(spark, "aggregates")
    ms = (F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long").alias("t")
    one = F.struct(ms, F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                   F.col("volume").cast("double").alias("v"), F.col("vwap").alias("vw"), F.col("trade_count").alias("n"))
    pages = b.select("symbol", F.floor(F.col("_t") / 50).alias("page"), one.alias("r")).groupBy("symbol", "page").agg(F.collect_list("r").alias("results"))
    pages.drop("page").write.json(path)
    return LD.read_aggregates(spark, path).select("symbol", "timestamp", "open", "close", "volume", "transactions")


@query("""WITH l AS (SELECT concat('S', p_partkey % 99999) AS symbol, p_partkey AS k FROM part)
    SELECT symbol FROM l WHERE length(symbol) <= 5 AND k % 7 <> 0""")
def listing_files(spark, sf):
    """A pipe-separated listing with a header and a trailer, written and read back."""
    path, k = new_path(spark, "listing"), F.col("p_partkey")
    rows = V.table(spark, sf, "part").select(
        F.when(k % 7 != 0, F.concat(F.lit("S"), k % 99999)).otherwise(F.lit("File Creation Time: 0101")).alias("Symbol"),
        F.col("p_name").alias("Security Name"),
    )
    rows.write.option("sep", "|").option("header", True).csv(path)
    return U.listed_symbols(LD.read_listing(spark, path))


@query("""SELECT concat('D', c_custkey) AS symbol, c_name AS company_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS delist_reason,
    (1990 + c_custkey % 30)::INTEGER AS delist_year FROM customer""")
def delisted_files(spark, sf):
    """The bulk file of delisted symbols, written and read back; a reason may be missing."""
    path, k = new_path(spark, "delisted"), F.col("c_custkey")
    rows = V.table(spark, sf, "customer").select(
        F.concat(F.lit("D"), k).alias("symbol"), F.col("c_name").alias("company_name"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).alias("delist_reason"), (k % 30 + 1990).cast("int").alias("delist_year"),
    )
    rows.write.option("header", True).csv(path)
    return LD.read_delisted_csv(spark, path)


@query(
    final(
        f"""(WITH {V.WEEKLY} SELECT symbol, time, close, CASE WHEN close > 2000 THEN 1 ELSE 0 END AS delist_30d,
        CAST(substr(symbol, 8) AS INTEGER) % 3 = 0 AS delisted FROM bars)""",
        "close",
    )
)
def delisted_store(spark, sf):
    """Delisted prices and labels, written as tables and loaded together."""
    prices, labels = new_path(spark, "prices"), new_path(spark, "labels")
    b = V.weekly_layer(spark, sf).select("symbol", "time", "close")
    BS.write_bars(b, prices)
    gone = (F.substring("symbol", 8, 4).cast("int") % 3 == 0).alias("delisted")
    b.select(F.col("symbol").alias("Symbol"), F.col("time").alias("Date"), (F.col("close") > 2000).cast("int").alias("delist_30d"), gone).write.parquet(labels)
    return BS.load_delisted(spark, prices, labels)


@query("""SELECT doc_id, DATE '2024-01-01' + (doc_id % 40)::INTEGER AS date, concat('http://n.example/', doc_id) AS url, (doc_id % 21 - 10)::DOUBLE AS tone,
    (doc_id % 5)::INTEGER AS n_themes FROM documents WHERE doc_id % 6 <> 0""")
def graph_files(spark, sf):
    """Knowledge-graph lines, some with too many fields, written and read back."""
    path, k = new_path(spark, "graph"), F.col("doc_id")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")), "yyyyMMdd000000")
    themes = F.array_join(F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), lambda i: F.concat(F.lit("ECON_"), i)), ";")
    fields = {G.DATE: date, G.SOURCE: F.lit("s"), G.URL: F.concat(F.lit("http://n.example/"), k), G.THEMES: F.when(k % 5 > 0, themes).otherwise(""),
              G.TONE: F.concat(k % 21 - 10, F.lit(",0,0,0,12"))}
    row = F.concat_ws("\t", *(fields.get(i, F.lit("")) for i in range(G.WIDTH)), F.when(k % 6 == 0, F.lit("too many")))
    V.table(spark, sf, "documents").select(row.alias("value")).write.text(path)
    doc_id = F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id")
    return G.read_graph_records(spark, path).select(doc_id, "date", "url", "tone", F.size("themes").alias("n_themes"))


@query(f"""WITH c AS (SELECT c_custkey AS k, concat('C', c_custkey) AS symbol, c_acctbal * 30000000 AS market_cap FROM customer)
    SELECT {CAP} AS tier, count(*) AS n, count(*) AS n_listed, count(DISTINCT symbol) AS n_symbols, min(k) AS first, max(k) AS last FROM c GROUP BY 1""")
def manifest_files(spark, sf):
    """Manifests of all customers' cap tiers written and read back: counts, the summary and the symbol lists agree."""
    path = new_path(spark, "manifest")
    tier = U.cap_tier(F.col("c_acctbal") * 30000000).alias("tier")
    tiers = V.table(spark, sf, "customer").select(tier, F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    BS.write_manifest(tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), tiers, path)
    counts = spark.read.schema("tier string, n long").json(f"{path}/counts")
    summary = spark.read.schema("tier string, n long").option("header", True).csv(f"{path}/summary")
    number = F.substring("value", 2, 20).cast("long")
    lists = spark.read.schema("value string, tier string").text(f"{path}/symbols").groupBy("tier")
    listed = lists.agg(F.count(F.lit(1)).alias("n_listed"), F.countDistinct("value").alias("n_symbols"), F.min(number).alias("first"), F.max(number).alias("last"))
    return counts.join(summary, ["tier", "n"]).join(listed, "tier")


@query(f"""WITH {V.WEEKLY}, s AS (SELECT DISTINCT symbol FROM bars)
    SELECT symbol, CASE WHEN CAST(substr(symbol, 8) AS INTEGER) % 4 = 0 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN CAST(substr(symbol, 8) AS INTEGER) % 4 = 0 THEN 'missing columns: close, volume' END AS reason FROM s""")
def preparation_status(spark, sf):
    """Status per symbol of two layers, one of which lacks columns."""
    b = V.weekly_layer(spark, sf).select("symbol", "open", "high", "low", "close", "volume")
    lacking = F.substring("symbol", 8, 4).cast("int") % 4 == 0
    return FA.status_rows(b.filter(~lacking)).unionByName(FA.status_rows(b.filter(lacking).drop("close", "volume")))


@query(
    final(
        f"""(WITH {V.WEEKLY} SELECT symbol, time, close AS price, 'halt' AS message, epoch_ms(time) AS stamp FROM bars WHERE close > high * 0.999)""",
        "price",
    )
)
def alert_messages(spark, sf):
    """Alert messages, published as files and read back."""
    path = new_path(spark, "alerts")
    b = V.weekly_layer(spark, sf).filter(F.col("close") > F.col("high") * 0.999)
    alerts = MS.alert_message(b, F.to_json(F.struct("symbol", "close", F.lit("halt").alias("text"))), F.lit("high"))
    alerts.write.parquet(path)
    body = F.from_json("value", "type string, message string, severity string, timestamp long")
    m = spark.read.parquet(path).select("time", body.alias("b")).filter("b.type = 'alert' AND b.severity = 'high'")
    inner = m.select("time", F.col("b.timestamp").alias("stamp"), F.from_json("b.message", "symbol string, close double, text string").alias("x"))
    return inner.select("x.symbol", "time", F.col("x.close").alias("price"), F.col("x.text").alias("message"), "stamp")


@query(f"""WITH {V.WEEKLY}, n AS (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS t FROM bars)
    SELECT symbol, time, true AS finite, true AS better_than_mean FROM n WHERE t >= 20""")
def boosted_return_model(spark, sf):
    """Boosted trees with early stopping: a prediction for every row with features, better than the mean on its own rows."""
    x = ["momentum_5", "momentum_20", "volume_ratio"]
    rows = factors(spark, sf).select("symbol", "time", *x).withColumn("y", F.col("momentum_5") * 2 + F.col("momentum_20"))
    known = rows.na.drop(subset=[*x, "y"]).withColumn("held", F.pmod(F.xxhash64("symbol", "time"), F.lit(5)) == 0)
    model = SC.fit_return_model(known, x, "y", validation="held", kind="trees")
    p = SC.predict_return(model, known, x)
    mean = known.agg(F.avg("y")).scalar()
    gain = p.agg((F.sum(F.pow(F.col("y") - F.col("predicted_return"), 2)) < F.sum(F.pow(F.col("y") - mean, 2)))).scalar()
    return p.select("symbol", "time", (~F.isnan("predicted_return")).alias("finite"), gain.alias("better_than_mean"))
