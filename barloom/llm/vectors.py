"""Integer vectors: quantising in Spark, matrices and exact inner products inside tasks, meetings of queries and buckets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.stage import stage

#: Components beyond this are refused: sums over a few hundred products of them would leave 64 bits.
LIMIT = 1 << 27
#: Float64 holds all integers up to here.
EXACT = float(1 << 53)
#: In place of a null id inside tasks; larger than any other, so it is last among ties.
NO_ID = 2**63 - 1


def whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """Every component x as floor(scale * x), x as double; beyond ``LIMIT`` it is an error."""

    def one(x):
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(y) <= LIMIT, y.cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("int"))

    return F.transform(vector, one)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder with a number ``row`` of its own for every row."""
    return stage(df.withColumn("row", F.monotonically_increasing_id()), name)


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Lists of numbers as rows of a matrix as wide as the longest of them; missing components are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(lengths.max(initial=0))
    if len(flat) == n * width:
        return flat.astype(kind).reshape(n, width)
    out = np.zeros((n, width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), kind))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exactly, as longs."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    longest = np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0) * np.einsum("ij,ij->i", b, b).max(initial=0))
    if longest < EXACT:  # no partial sum is larger either
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def meet(queries: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``work`` to every block of queries and bucket of rows that has something to do with each other.

    ``queries`` has a row for every query and bucket that it visits, in columns ``block`` and ``bucket``; both have a
    bounded number of rows. Only buckets that a block visits are sent to it.
    """
    wanted = queries.select("block", "bucket").distinct().toDF("block", "bucket")
    sent = rows.join(wanted, "bucket")
    keys = ["block", "bucket"]
    return queries.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(work, schema)


def blocks_of(number: str, n: int, size: int) -> Column:
    """Deals rows to blocks of about ``size`` by the hash of their number."""
    return F.pmod(F.xxhash64(number), F.lit(max(1, -(-n // size)))).cast("int")
