"""Benchmark decontamination: short test items inside long documents, with DataFrame functions only.

The similarity of a twenty-shingle item and a long document says nothing, so the search is for containment, and one
sided. Items are partitioned by size. An item's signature is its smallest shingle hashes, as many as its partition
needs: if a document holds at least ``percent`` hundredths of the item's n shingles, it lacks n - ceil(n * percent / 100) at most,
so one more minimum than that always meets one that the document has; the partition's largest size sets the number for
all its items. Of a document's shingles those that any item has are kept; documents and items are paired through the
minima alone, and only for these pairs the item's shingles that the document has are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import packed, unpacked
from barloom.sources.stage import stage

SIZE = 5
#: Shares into which a shingle's documents are dealt where the index is joined by shuffle.
SALT = 16
#: Rows of the benchmark's index that may be broadcast: 16 MB of hashes and ids.
BROADCAST_ROWS = 1 << 20


def _words(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.array_remove(words, "")


def _shingles(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, h): one row per shingle place of every whole text."""
    split = rows.select(F.col(key), _words(F.col(text)).alias("_w"))
    places = F.when(F.size("_w") >= size, F.sequence(F.lit(0), F.size("_w") - size))
    at = split.select(key, "_w", F.explode(places).alias("_i"))
    return at.select(key, F.xxhash64(*(F.get("_w", F.col("_i") + k) for k in range(size))).alias("h"))


def index(benchmark: DataFrame, size: int = SIZE, percent: int = 80, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, n (distinct shingles), h and ``minimum`` (whether h is in the item's signature), one row per shingle."""
    each = _shingles(benchmark, key, text, size).distinct()
    sized = each.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    n = F.size("hs")
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1  # of the item's partition: sizes from 2^c to 2^(c+1) - 1
    minima = F.least(n, (largest - F.ceil(largest * percent / 100) + 1).cast("int"))
    rows = sized.select(key, n.alias("n"), minima.alias("_m"), F.posexplode("hs").alias("_p", "h"))
    return rows.select(key, "n", "h", (F.col("_p") < F.col("_m")).alias("minimum"))


def _met(shingles: DataFrame, hashes: DataFrame, few: bool) -> DataFrame:
    """(_d, h) of the document shingles that are among the hashes; a frequent one is dealt to several tasks."""
    if few:
        return shingles.join(F.broadcast(hashes), "h", "left_semi").distinct()
    dealt = hashes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    mine = shingles.distinct().withColumn("_s", F.pmod(F.xxhash64("_d"), F.lit(SALT)).cast("int"))
    return mine.join(dealt, ["h", "_s"], "left_semi").drop("_s")


def candidates(hits: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """Pairs of a document and an item of which it has a minimum: _d, _item and n."""
    minima = items.filter("minimum").select("h", "_item", "n")
    if few:
        return hits.join(F.broadcast(minima), "h").select("_d", "_item", "n").distinct()
    minima = minima.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = hits.withColumn("_s", F.pmod(F.xxhash64("_d"), F.lit(SALT)).cast("int"))
    return dealt.join(minima, ["h", "_s"]).select("_d", "_item", "n").distinct()


def contained_items(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment for items of which a document has ``percent`` hundredths.

    Shingles are ``size`` words of the lower-cased whole text, each counted once. Items with fewer words have none and
    are never found, nor are null texts; rows with one id count as one document, rows without id as one as well. The
    benchmark's index is written, counted and broadcast up to a million rows, else joined by shuffle, a shingle's documents
    dealt to ``SALT`` tasks. The document shingles that meet it are written. No rows give no rows; other columns are not read.
    """
    items = stage(index(benchmark.select(F.col("item_id").alias("_item"), "text"), size, percent, "_item"), "benchmark-index")
    few = items.count() <= BROADCAST_ROWS
    side = F.broadcast if few else lambda df: df
    rows = docs.select(F.struct(F.col(key).alias("id")).alias("_d"), F.col(text).alias("_text"))  # a struct is never null
    hits = stage(_met(_shingles(rows, "_d", "_text", size), items.select("h").distinct(), few), "benchmark-hits")
    wanted = candidates(hits, items, few).join(side(items.select("_item", "h")), "_item")
    pairs = wanted.join(hits, ["_d", "h"]).groupBy("_d", "_item", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    held = pairs.filter(100 * F.col("n_shared") >= percent * F.col("n"))
    return held.select(F.col("_d.id").alias(key), F.col("_item").alias("item_id"), F.col("n").cast("long").alias("n_shingles"), "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all rows and columns of them, whatever the columns are called.

    Null and empty texts hold none and stay; rows that share an id go together, rows without id too; no rows give no rows.
    """
    found = stage(contained_items(docs, benchmark).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    rows = packed(docs, "doc_id")
    return unpacked(rows.join(found, F.col("_doc_id").eqNullSafe(F.col("_found")), "left_anti"), docs)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
bs AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM v)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, k AS n_shared, round(k / n, 6) AS containment
FROM c JOIN n USING (item_id) WHERE 100 * k >= 80 * n
"""
