"""Exact search for the largest inner products by norm-bucketed retrieval.

Rows are grouped by length into buckets of a bounded size. A query first meets the bucket of the longest rows, which
gives it a k-th best score so far, and with that a local cosine threshold for every other bucket: the score divided by
the query's length and the bucket's largest. Above 1 the bucket, and with it all shorter ones, is not visited. In a
visited bucket the threshold chooses how rows are ruled out: below ``STEEP`` by length alone (rows are in order of
length, so a prefix is left), from there on by coordinates: the products over the query's few largest components, plus
the product of the lengths of what remains, must reach the score. What is left is verified by whole products.

Queries and buckets meet in blocks of bounded size (``vectors.meet``); nothing grows with a hot length or vector, and
ties at the threshold are kept, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ids_of
from barloom.llm.vectors import EXACT, NO_ID, blocks_of, integers, matrix, meet, numbered, products, whole
from barloom.sources.stage import stage

#: Rows of a bucket and queries of a block, about.
BUCKET = 2048
BLOCK = 2048
#: Levels of length in an octave of the squared length: there are some 2,000 levels at most.
LEVELS = 32
#: From this local cosine threshold on rows are ruled out by coordinates, below by length.
STEEP = 0.3
#: Components of a query that the coordinate bound looks at.
FOCUS = 12
PIECE = 256


def top_products(
    df: DataFrame, queries: Column, *, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding",
    bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """For every row that fulfils ``queries`` the k largest inner products with other rows.

    Vectors that are null or hold a null or non-finite component take no part; components become floor(scale * x).
    Vectors of different lengths are multiplied over the components that both have, so an empty vector scores 0 with
    all. Ties go to the smaller id, a null id comes last; a row with the query's id is the query itself, repeated query
    rows are one query, repeated candidates are candidates of their own. Fewer than k other rows give fewer results,
    no rows none. Other columns are not looked at. Components beyond 2^27 are an error.

    Columns: query_id, rank (from 1), the id, score.
    """
    v = integers(vector, scale)
    ok = df.filter(whole(vector)).select(F.col(id).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    rows = numbered(ok.withColumn("square", square).withColumn("level", level_of(F.col("square"))), "vectors")
    counts = {r.level: r.n for r in rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = _buckets(rows, counts, bucket)
    asking = rows.filter("asks").groupBy("id", "v", "square").agg(F.min("row").alias("query"))
    asking = stage(asking, "queries")
    asking = asking.withColumn("block", blocks_of("query", asking.count(), block))
    least = F.lit(None).cast("long")
    first = stage(_meet(asking.withColumn("bucket", F.lit(0)).withColumn("least", least), buckets, k), "first")
    edge = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    known = asking.join(edge.select("query", "least"), "query", "left")
    visits = _visits(known, counts, bucket)
    both = first.unionByName(_meet(visits, buckets, k))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = F.when(F.col("key") != NO_ID, F.col("key"))
    return ranked.select("query_id", "rank", found.alias(id), "score")


def level_of(square: Column) -> Column:
    """Level of a squared length; longer rows have a larger one."""
    return F.floor(F.log2(square.cast("double") + 1) * LEVELS).cast("int")


def _plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """(level, first bucket, buckets) from the longest level on: small levels share a bucket, large ones are split."""
    out, at, held = [], 0, 0
    for level in sorted(counts, reverse=True):
        n = counts[level]
        if held and held + n > size:
            at, held = at + 1, 0
        split = max(1, math.ceil(n / size))
        out.append((level, at, split))
        held = held + n if split == 1 else size
        at += split - 1
    return out


def _buckets(rows: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    plan = _plan(counts, size)
    table = rows.sparkSession.createDataFrame(plan, "level int, first int, split int")  # some 2,000 levels at most
    dealt = F.col("first") + F.pmod(F.xxhash64("row"), F.col("split")).cast("int")
    return rows.join(F.broadcast(table), "level").select("id", "v", "square", dealt.alias("bucket"))


def _visits(known: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """The further buckets of every query: those that hold a row long enough for its k-th best score."""
    plan = _plan(counts, size)
    longest = max(counts, default=0)
    upto = [0] * (longest + 2)  # buckets that hold rows of a level or above
    for level, first, split in plan:
        upto[level] = first + split
    for level in range(longest, -1, -1):
        upto[level] = max(upto[level], upto[level + 1])
    reach = known.sparkSession.createDataFrame(list(enumerate(upto)), "needs int, upto int")
    score = F.col("least").cast("double")
    square = score * score / F.col("square") * F.lit(1 - 1e-9)
    needs = F.when((score > 0) & (F.col("square") > 0), F.least(level_of(square), F.lit(longest + 1))).otherwise(0)
    far = known.withColumn("needs", needs.cast("int")).join(F.broadcast(reach), "needs").filter("upto > 1")
    return far.withColumn("bucket", F.explode(F.sequence(F.lit(1), F.col("upto") - 1))).drop("needs", "upto")


FOUND = "query long, query_id long, key long, score long"


def _meet(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    def work(q: pa.Table, rows: pa.Table) -> pa.Table:
        ids = ids_of(q.column("id"), NO_ID)
        least = q.column("least").fill_null(-(2**62)).to_numpy()
        keys, squares = ids_of(rows.column("id"), NO_ID), rows.column("square").to_numpy()
        parts = list(search(ids, matrix(q.column("v")), least, keys, matrix(rows.column("v")), squares, k))
        at, key, score = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((),) * 3))
        number = q.column("query").to_numpy()
        return pa.table({"query": number[at], "query_id": q.column("id").take(pa.array(at)), "key": key, "score": score})

    asked = queries.select("query", "id", "v", "square", "least", "block", "bucket")
    return meet(asked, buckets, work, FOUND)


def search(
    ids: np.ndarray, queries: np.ndarray, least: np.ndarray, keys: np.ndarray, rows: np.ndarray, squares: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best rows of one bucket for each query, of those that reach its ``least`` score: (query, key, score)."""
    if not len(rows) or not len(queries):
        return
    order = np.lexsort((keys, -squares))
    keys, rows, squares = keys[order], rows[order], squares[order].astype(float)
    long = np.sqrt(squares)
    own = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    for at in range(0, len(queries), PIECE):
        q = slice(at, at + PIECE)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where((own[q] > 0) & (long[0] > 0), least[q] / (own[q] * long[0]), np.where(least[q] > 0, np.inf, -np.inf))
        local = local * (1 - 1e-9 * np.sign(local))
        by_length = np.flatnonzero(local < STEEP)
        if len(by_length):
            yield from _by_length(at + by_length, ids, queries, least, own, keys, rows, long, k)
        for i in at + np.flatnonzero((local >= STEEP) & (local <= 1)):
            yield _by_coordinates(i, ids, queries, least, own, keys, rows, squares, long, k)


def _by_length(which, ids, queries, least, own, keys, rows, long, k):
    """Rows too short for a query's score are ruled out: of rows in order of length a prefix is left."""
    with np.errstate(divide="ignore", invalid="ignore"):
        short = np.where((own[which] > 0) & (least[which] > 0), least[which] / own[which] * (1 - 1e-9), 0.0)
    prefix = np.searchsorted(-long, -short, "right")
    score = products(queries[which], rows[: prefix.max(initial=0)])
    for j, i in enumerate(which):
        yield _best(i, ids, keys[: prefix[j]], score[j, : prefix[j]], least[i], k)


def _by_coordinates(i, ids, queries, least, own, keys, rows, squares, long, k):
    """Rows are ruled out by the query's largest components and the lengths of the rest."""
    width = min(queries.shape[1], rows.shape[1])
    q = queries[i, :width]
    focus = np.argpartition(-np.abs(q), min(FOCUS, width) - 1)[:FOCUS] if width else np.zeros(0, int)
    near = rows[: np.searchsorted(-long, -least[i] / own[i] * (1 - 1e-9), "right")]
    seen = near[:, focus]
    part = seen @ q[focus]
    rest = np.sqrt(np.maximum(squares[: len(near)] - np.einsum("ij,ij->i", seen, seen), 0.0))
    more = math.sqrt(max(float(q @ q - q[focus] @ q[focus]), 0.0))
    slack = 1e-6 + 1e-9 * (np.abs(part) + rest * more) + (1e-7 * long[0] * more if squares[0] >= EXACT else 0)
    left = np.flatnonzero(part + rest * more + slack >= least[i])
    return _best(i, ids, keys[left], products(q[None], near[left])[0], least[i], k)


def _best(i, ids, keys, score, least, k):
    fine = (score >= least) & ((keys != ids[i]) if ids[i] != NO_ID else True)
    keys, score = keys[fine], score[fine]
    if len(score) > 8 * k:  # ties with the k-th stay
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keys, score = keys[score >= edge], score[score >= edge]
    order = np.lexsort((keys, -score))[:k]
    return np.full(len(order), i), keys[order], score[order]
