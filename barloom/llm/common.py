"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text are runs of anything but these six ASCII characters; ``bytes.split()`` cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot from a thousandth of all rows on, so there are a thousand hot keys at most.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of a string column as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def ids_of(column: pa.Array | pa.ChunkedArray, missing: int) -> np.ndarray:
    """A long column as numpy; null becomes ``missing``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame, *names: str) -> DataFrame:
    """Whole rows in one column ``_row``, and the named columns again with a ``_`` before their names.

    Whatever a caller's columns are called, they do not meet those of a join.
    """
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(F.col(c).alias(f"_{c}") for c in names))


def unpacked(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``like`` out of ``_row``, and further ones, which replace those of their names."""
    new = df.select(*more).columns if more else []
    return df.select(*(F.col("_row").getField(c).alias(c) for c in like.columns if c not in new), *more)


def left_join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, row_id: Column) -> DataFrame:
    """Left join with a table of unique keys, where one key may hold a large share of ``rows``.

    ``keyed`` has the number of rows of every key in ``n`` and is joined in two parts: keys with more than a
    thousandth of all rows (a thousand keys at most, hence broadcast) and the rest, shuffled. Rows whose key was hot,
    or is null, are dealt by ``row_id`` in the second part, so no task gets a hot key's rows.
    """
    extra = [c for c in keyed.columns if c != key]
    hot = F.col(n) > F.lit(max(1, total // HOT_SHARE))
    few = keyed.filter(hot).select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in extra))
    rest = keyed.filter(~hot).withColumnRenamed(key, "_key").withColumn("_by_row", F.lit(False))
    found = rows.join(F.broadcast(few), key, "left")
    by_row = F.coalesce(F.col("_hot"), F.lit(False)) | F.col(key).isNull()
    kind = keyed.schema[key].dataType
    found = found.withColumn("_dealt", F.when(by_row, row_id.cast(kind)).otherwise(F.col(key))).withColumn("_by_row_left", by_row)
    joined = found.join(rest, (F.col("_dealt") == F.col("_key")) & (F.col("_by_row_left") == F.col("_by_row")), "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in extra))
