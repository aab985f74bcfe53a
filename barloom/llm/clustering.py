"""Centroid clustering over compressed vectors (VA-file): cells decide, full vectors only where their intervals overlap.

Every vector is written once as whole numbers and once as cells: a number of few bits per dimension, between marks laid
over mean and deviation of the dimension. In a round a task looks up, for every dimension and cell, the least and the
largest amount by which a centroid can be further away than a reference centroid (the one of the vector's cluster so
far; the mean of all in the first round): the part of the distance that all centroids share cancels, so the intervals are
narrow. If the interval of one centroid lies below all others, the vector is decided without being read. Centroids
are kept as exact sums: a vector that stays where it was changes no sum, so only vectors that moved or whose intervals
overlap are fetched, by a join on their row number, and the latter are measured exactly.

Per round the cells (a fifth of the vectors) are scanned and what must be fetched is shuffled. The driver gets K sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.vectors import integers, lists, matrix, numbered, whole
from barloom.sources.stage import stage

#: Bits of a cell.
BITS = 7
#: Cells are of one width up to so many deviations from the mean; the outer ones reach to the extremes.
REACH = 4.0
PIECE = 8192


def cluster(
    df: DataFrame, *, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024, bits: int = BITS,
    id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """K-means with exact arithmetic; one row per kept vector.

    Kept are vectors of ``dims`` components, none of them null or not finite. Centroids start as the k vectors with the
    smallest SHA-256 of ``seed:id`` and move ``rounds`` times to the rounded-down mean of their vectors; a tie goes to
    the smaller number, a centroid without vectors stays. Equal vectors and repeated rows are rows of their own; a null
    id takes part and is the last to start a centroid, with fewer than k vectors there are as many centroids, without
    any the result is empty. Other columns are not looked at. Components beyond 2^27 are an error.

    Columns: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    """
    kept = df.filter(whole(vector) & (F.size(vector) == dims)).select(F.col(id).alias("id"), integers(vector, scale).alias("v"))
    vectors = numbered(kept, "vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = vectors.orderBy(first.asc_nulls_last(), "id", "v").limit(k).select("v").collect()
    if not start:
        start = [([0] * dims,)]
    centroids = np.array([r[0] for r in start], np.int64)
    bounds = _cells(vectors, dims, bits)
    state = stage(_mapped(vectors, _first(bounds, centroids), f"{STATE}, {MOVED}"), "cells")
    total = _Totals(len(centroids), dims)
    total.add(state)
    state = state.filter("kind = 0").select(*STATE_COLUMNS)
    for _ in range(rounds - 1):
        before, centroids = centroids, total.centroids(centroids)
        if np.array_equal(before, centroids):  # nothing moves any more
            break
        judged = stage(_mapped(state, _by_cells(bounds, centroids), JUDGED), "judged")
        fetched = judged.filter("new IS NULL OR new <> old").join(vectors.select("row", "v"), "row")
        moved = stage(_mapped(fetched, _by_vectors(centroids), f"{STATE}, {MOVED}"), "moved")
        total.add(moved)
        still = judged.filter("new = old").select("row", "cells", F.col("old").alias("cluster"))
        state = still.unionByName(moved.filter("kind = 0").select(*STATE_COLUMNS))
    centroids = total.centroids(centroids)
    rows = _mapped(vectors, _last(bounds, centroids), "id long, cluster int, distance long")
    rows = stage(rows, "assigned")
    return _with_inertia(rows, centroids, id)


STATE_COLUMNS = ("row", "cells", "cluster")
STATE = "row long, cells array<tinyint>, cluster int"
#: Rows of kind 1 are the change of a task's vectors to the number and sum of a cluster.
MOVED = "kind int, n long, total array<long>"
JUDGED = "row long, cells array<tinyint>, old int, new int"


def _mapped(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


class _Totals:
    """Number and sum of the vectors of every cluster, as Python's unbounded integers."""

    def __init__(self, k: int, dims: int):
        self.n, self.total = [0] * k, [[0] * dims for _ in range(k)]

    def add(self, written: DataFrame) -> None:
        """Add the changes that the tasks wrote, summed in Spark: a row for every cluster."""
        dims = range(len(self.total[0]))
        part = written.filter("kind = 1").groupBy("cluster")
        for r in part.agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in dims)).collect():
            self.n[r.cluster] += r.n
            for d in dims:
                self.total[r.cluster][d] += int(r[f"d{d}"])

    def centroids(self, before: np.ndarray) -> np.ndarray:
        return np.array([[x // n for x in s] if n else list(c) for n, s, c in zip(self.n, self.total, before, strict=True)], np.int64)


# -- cells ---------------------------------------------------------------------------------------


def _cells(vectors: DataFrame, dims: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For every dimension and cell the least and largest whole number in it."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        lo, hi = np.full(dims, 2.0**60), np.full(dims, -(2.0**60))
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
            lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dims), "n": np.full(dims, n), "s": s, "q": q, "lo": lo, "hi": hi})

    parts = _mapped(vectors.select("v"), measured, "d long, n long, s double, q double, lo double, hi double")
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = sorted(found.collect())
    low, high = (np.zeros((dims, 1 << bits), np.int64) for _ in range(2))
    for d, r in enumerate(found):
        mean = r.s / r.n
        spread = np.sqrt(max(r.q / r.n - mean * mean, 0.0))
        steps = np.arange(1, 1 << bits) / (1 << bits) * 2 - 1
        marks = np.clip(np.rint(mean + REACH * spread * steps), r.lo, r.hi).astype(np.int64)
        low[d] = np.concatenate([[int(r.lo)], marks])
        high[d] = np.concatenate([np.maximum(marks - 1, low[d, :-1]), [int(r.hi)]])
    return low, high


def _coded(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The cell of every component, minus 128 to fit a signed byte for up to 8 bits."""
    cells = [np.searchsorted(low[d, 1:], x[:, d], "right") for d in range(x.shape[1])]
    return (np.stack(cells, 1) - 128).astype(np.int8)


def intervals(centroids: np.ndarray, reference: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance to each centroid minus that to the reference, by dimension and cell: all least ones, then all largest.

    (x - c)^2 - (x - r)^2 is linear in x, so its extremes are at the ends of the cell.
    """
    c, r = centroids.T[:, None, :].astype(float), reference[:, None, None].astype(float)
    at = [(x[:, :, None] - c) ** 2 - (x[:, :, None] - r) ** 2 for x in (low.astype(float), high.astype(float))]
    return np.concatenate([np.minimum(*at), np.maximum(*at)], 2)


def by_intervals(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The centroid whose interval lies below all others, else -1."""
    both = np.zeros((len(cells), table.shape[2]))
    for d in range(cells.shape[1]):
        both += table[d].take(cells[:, d].astype(np.intp) + 128, 0)
    least, most = np.split(both, 2, 1)
    best = most.argmin(1)
    edge = most[np.arange(len(best)), best]
    slack = 1e-9 * (1 + np.abs(least).max(initial=0) + np.abs(most).max(initial=0))
    return np.where((least <= edge[:, None] + slack).sum(1) == 1, best, -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


# -- passes --------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def _state(row: pa.Array, cells: pa.Array, cluster: np.ndarray, dims: int) -> pa.RecordBatch:
    n = len(cluster)
    kinds = pa.array(np.zeros(n, np.int32))
    return pa.RecordBatch.from_arrays([row, cells, pa.array(cluster.astype(np.int32)), kinds, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=[*STATE_COLUMNS, "kind", "n", "total"])


def _changes(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    which = np.flatnonzero((n != 0) | total.any(1))
    k, n, total = len(which), n[which], total[which]
    nothing = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int8()))]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(which.astype(np.int32)), pa.array(np.ones(k, np.int32)), pa.array(n), lists(total, pa.int64())], names=[*STATE_COLUMNS, "kind", "n", "total"])


def _first(bounds, centroids: np.ndarray) -> Callable:
    """Round one: cells are made, and all vectors enter the sums."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = intervals(centroids, centroids.mean(0), *bounds)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in _pieces(batches):
            x = matrix(b.column("v"), np.int64)
            cells = _coded(x, bounds[0])
            own = _settled(x, cells, table, centroids)
            _count(n, total, x, own, 1)
            yield _state(b.column("row"), lists(cells, pa.int8()), own, dims)
        yield _changes(n, total)

    return work


def _settled(x: np.ndarray, cells: np.ndarray, table, centroids: np.ndarray) -> np.ndarray:
    own = by_intervals(cells, table)
    open_ = np.flatnonzero(own < 0)
    own[open_] = distances(x[open_], centroids).argmin(1)
    return own


def _count(n: np.ndarray, total: np.ndarray, x: np.ndarray, cluster: np.ndarray, sign: int) -> None:
    for k in np.unique(cluster):
        of = cluster == k
        n[k] += sign * int(of.sum())
        total[k] += sign * x[of].sum(0)


def _by_cells(bounds, centroids: np.ndarray) -> Callable:
    """What the cells decide: the new cluster, or null where intervals overlap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in _pieces(batches):
            cells, old = matrix(b.column("cells"), np.int16), b.column("cluster").to_numpy()
            new = np.full(len(old), -1, np.int64)
            for o in np.unique(old):
                if o not in tables:
                    tables[o] = intervals(centroids, centroids[o], *bounds)
                of = old == o
                new[of] = by_intervals(cells[of], tables[o])
            found = pa.array(new.astype(np.int32), mask=new < 0)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), b.column("cluster"), found], names=["row", "cells", "old", "new"])

    return work


def _by_vectors(centroids: np.ndarray) -> Callable:
    """Fetched vectors: the undecided are measured; those that moved leave one sum and enter another."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in _pieces(batches):
            x, old = matrix(b.column("v"), np.int64), b.column("old").to_numpy()
            new = b.column("new").fill_null(-1).to_numpy().astype(np.int64)
            open_ = np.flatnonzero(new < 0)
            new[open_] = distances(x[open_], centroids).argmin(1)
            went = new != old
            _count(n, total, x[went], old[went], -1)
            _count(n, total, x[went], new[went], 1)
            yield _state(b.column("row"), b.column("cells"), new, dims)
        yield _changes(n, total)

    return work


def _last(bounds, centroids: np.ndarray) -> Callable:
    """The last assignment, with the distance: all vectors are read, and measured to what the cells leave open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = intervals(centroids, centroids.mean(0), *bounds)
        for b in _pieces(batches):
            x = matrix(b.column("v"), np.int64)
            own = _settled(x, _coded(x, bounds[0]), table, centroids)
            d = x - centroids[own]
            far = np.einsum("ij,ij->i", d, d)
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(own.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return work


def _with_inertia(rows: DataFrame, centroids: np.ndarray, id: str) -> DataFrame:
    spark = rows.sparkSession
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    found = {r.cluster: r.cluster_inertia for r in sums}
    per = [(k, found.get(k, 0), sum(found.values()), sha) for k, sha in names]
    few = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(few), "cluster")
    return out.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
