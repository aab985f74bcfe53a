"""Written intermediate layers: cut long lineages and read a costly result once.

The folder is the session's ``spark.checkpoint.dir``, which on a cluster is shared, so a lost executor
does not lose a layer. Where it is unset a temporary folder is used in a local run; on a cluster that is an error, since
executors on other machines could not read it. All layers of an application lie under ``barloom/<application id>``, so
they can be removed together when it has ended.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_layers: dict[tuple[str, str, str, int], str] = {}


def stage_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own_root.setdefault(app, "")
        if not root:
            root = _own_root[app] = tempfile.mkdtemp(prefix="barloom-")
    return root


def stage(df: DataFrame, name: str = "layer") -> DataFrame:
    """Write a frame to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application that has not been used."""
    return f"{stage_root(spark)}/barloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files, not one file; the path may be a pattern."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place)
    return any(s.isDirectory() for s in found or ())


def fingerprint(spark: SparkSession, folder: str) -> int:
    """Changes with the names, times and sizes of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    seen = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return int(files.agg(F.sum(seen)).first()[0] or 0)


def layer(spark: SparkSession, name: str, folder: str, build) -> DataFrame:
    """A stored layer of this application: built on first use and when the files in ``folder`` change, else scanned."""
    key = (spark.sparkContext.applicationId, name, folder, fingerprint(spark, folder))
    if key not in _layers:
        path = new_path(spark, "layer")
        build().write.parquet(path)
        _layers[key] = path
    return spark.read.parquet(_layers[key])
