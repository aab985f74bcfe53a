"""Mixing sources to target weights by pivotal rounding, with DataFrame functions only.

Every document of a source is to be taken target / source size times. The whole part is certain; the fraction is
rounded by pivots: two documents exchange words of probability mass at random (the expectation of both and the sum of
their expected words stay) until one of them is integral. Blocks of a few dozen documents leave one fractional document
each; these meet in blocks of the next level, up to one per source. So a source's taken words miss its target by half
the size of one document at most, and no task sees more than a block however large a source is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import left_join_hot, n_words, packed, unpacked
from barloom.sources.stage import stage

#: Documents of a block, on average.
BLOCK = 32


def ranked_sources(units: DataFrame) -> DataFrame:
    """source, source_size, n (rows) and rank from 1 in code-point order, null last, without one task for all of them."""
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    parts = stage(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    # one row per partition, not per source
    before = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    ranked = parts.withColumn("_within", within).join(before.select("_part", "_before"), "_part")
    return stage(ranked.select("source", "source_size", "n", (F.col("_within") + F.col("_before")).alias("rank")), "mix-ranks")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, no source above ``most`` times its size.

    A source that is above stops there and the excess goes to the others by weight, again until none is above. The
    others all stand at the same multiple of their weight, so a round is one aggregate and one number on the driver.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sources.withColumn("_w", w).withColumn("_cap", F.lit(most) * F.col("source_size"))
    level = -math.inf
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w") if level > 0 else F.lit(False)
        got = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        total, held, free = (float(x or 0) for x in got)
        new = (share * total - held) / free if free else level
        if not new > level:
            break
        level = new
    return rows.withColumn("target", F.least(F.col("_cap"), F.lit(max(level, 0.0)) * F.col("_w"))).drop("_w", "_cap")


def _uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _pivot(acc: Column, b: Column) -> Column:
    """One meeting of the carried document ``acc.cur`` and ``b``: one of them becomes integral and leaves."""
    a = acc["cur"]
    up = F.least(a["s"] * (1 - a["p"]), b["s"] * b["p"])
    down = F.least(a["s"] * a["p"], b["s"] * (1 - b["p"]))
    raised = _uniform(a["o"], b["o"], a["s"], b["s"]) * (up + down) < down
    # exactly 0 or 1 for the side that has reached its end
    a_full, b_empty = a["s"] * (1 - a["p"]) <= b["s"] * b["p"], b["s"] * b["p"] <= a["s"] * (1 - a["p"])
    a_empty, b_full = a["s"] * a["p"] <= b["s"] * (1 - b["p"]), b["s"] * (1 - b["p"]) <= a["s"] * a["p"]
    pa = F.when(raised, F.when(a_full, 1.0).otherwise(a["p"] + up / a["s"])).otherwise(F.when(a_empty, 0.0).otherwise(a["p"] - down / a["s"]))
    pb = F.when(raised, F.when(b_empty, 0.0).otherwise(b["p"] - up / b["s"])).otherwise(F.when(b_full, 1.0).otherwise(b["p"] + down / b["s"]))
    done = (a["p"] <= 0) | (a["p"] >= 1)
    a2, b2 = a.withField("p", F.when(done, a["p"]).otherwise(pa)), b.withField("p", F.when(done, b["p"]).otherwise(pb))
    a_leaves = (a2["p"] <= 0) | (a2["p"] >= 1)
    return F.struct(
        F.concat(acc["out"], F.array(F.when(a_leaves, a2).otherwise(b2))).alias("out"),
        F.when(a_leaves, b2).otherwise(a2).alias("cur"),
    )


def _level(rows: DataFrame) -> DataFrame:
    """Rows (group, block, u) -> decided rows and one left over per block (``left``)."""
    met = rows.groupBy("group", "block").agg(F.sort_array(F.collect_list("u")).alias("us"))
    start = F.struct(F.slice("us", 1, 0).alias("out"), F.element_at("us", 1).alias("cur"))
    done = met.select("group", "block", F.aggregate(F.slice("us", 2, F.size("us")), start, _pivot).alias("r"))
    each = F.concat(
        F.transform("r.out", lambda x: F.struct(F.lit(False).alias("left"), x.alias("u"))),
        F.array(F.struct(F.lit(True).alias("left"), F.col("r.cur").alias("u"))),
    )
    return done.select("group", "block", F.explode(each).alias("e")).select("group", "block", "e.left", "e.u")


def pivotal(rows: DataFrame, group: str, order: Column, size: Column, p: Column, blocks: Column, levels: int) -> DataFrame:
    """Round the probabilities ``p`` (strictly between 0 and 1, sizes above 0) of each group's rows to 0 or 1.

    Returns the columns of ``rows`` and ``_one``. ``blocks``: number of blocks of the row's group on the first level;
    ``levels``: how often blocks are met until every group is one block. Each level is a written table.
    """
    unit = F.struct(order.alias("o"), size.cast("double").alias("s"), p.alias("p"), F.struct(*rows.columns).alias("k"))
    at = rows.select(F.col(group).alias("group"), F.pmod(F.xxhash64(order, F.lit("block")), blocks).alias("block"), unit.alias("u"))
    decided = None
    for level in range(levels):
        met = stage(_level(at), f"mix-level{level}")
        last = level == levels - 1
        some = met if last else met.filter(~F.col("left"))
        # the one fractional document that a group ends with goes to the nearer side
        some = some.select("u.k.*", (F.col("u.p") >= 0.5).alias("_one"))
        decided = some if decided is None else decided.unionByName(some)
        at = met.filter("left").select("group", F.floor(F.col("block") / BLOCK).alias("block"), "u")
    return decided


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How often the mix takes each document; one row per input row.

    Returns ``keep`` (its first column identifies a document), source, size (words of the whole text, null: 0),
    source_size, target, copies (0, 1 or 2 for ``most`` = 2) and taken = size * copies. Documents without words are taken
    0 words; a null source is a source of its own; repeated rows are drawn each; no rows give no rows. The draw
    depends on keys and sizes alone, so reruns agree. Runs jobs and writes small tables (keys and sizes) when called.
    """
    extra = [c for c in keep if c != "source"]
    units = stage(docs.select(*extra, "source", n_words(F.col(text)).alias("size")), "mix-units")
    sources = targets(ranked_sources(units), weights, share, most)
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    total, largest = (x or 0 for x in sources.agg(F.sum("n"), F.max("n")).first())
    known = sources.select(named.alias("_s"), "source_size", "target", "n", "rank")
    rows = left_join_hot(units.withColumn("_s", named), known, "_s", "n", total, F.xxhash64(extra[0]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = stage(rows.withColumn("_whole", F.floor(rate + 1e-12)).withColumn("_p", F.greatest(rate - F.col("_whole"), F.lit(0.0))), "mix-rows")
    open_ = (F.col("size") > 0) & (F.col("_p") > 1e-12)
    levels = max(1, math.ceil(math.log(max(largest, 2), BLOCK)) + 1)
    order = F.xxhash64(*extra)
    drawn = pivotal(rows.filter(open_), "rank", order, F.col("size"), F.col("_p"), F.ceil(F.col("n") / BLOCK), levels)
    out = drawn.unionByName(rows.filter(~open_).withColumn("_one", F.lit(False)))
    copies = F.col("_whole") + F.col("_one").cast("long")
    return out.select(*extra, "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents the mix takes, with ``copies`` and ``taken`` (in place of columns of these names); untaken ones go.

    Rows alike in key and text share one draw, the larger; null and empty texts are not taken; a null id is an id of its own; no
    rows give no rows. Other columns stay as they are, whatever they are called.
    """
    same = F.xxhash64("text").alias("_same")
    drawn = mix(docs.select("doc_id", "source", "text", same), weights, share, most, keep=("doc_id", "_same"))
    drawn = drawn.filter("copies > 0").groupBy("doc_id", "_same").agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    rows = packed(docs, "doc_id", "text")
    on = F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("_text") == F.col("_same"))
    return unpacked(rows.join(drawn, on), docs, F.col("copies"), F.col("taken"))
