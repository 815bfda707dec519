"""The store behind Spark: existence, exclusive creation and deletion of paths, and a folder's listing as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. Of several callers one gets True."""
    fs, target = _path(spark, path)
    fs.mkdirs(target.getParent())
    try:
        return fs.createNewFile(target)
    except Exception as error:
        if fs.exists(target):
            return False
        raise error


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in one folder (not below it); none where there is no such folder."""
    fs, target = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; the machine's own only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors share no local folder")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/voltaflow-io"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below the root, with slashes), name, bytes of every file below the root; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    below = F.regexp_replace(F.replace("path", F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/")), F.lit("\u0000")), "^[^\u0000]*\u0000/*", "")
    return found.select(below.alias("path"), F.element_at(F.split(below, "/"), -1).alias("name"), F.col("length").alias("bytes"))
