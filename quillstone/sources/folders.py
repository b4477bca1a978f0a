"""Folders of batches (`batch=0`, `batch=1`, ...) that jobs add to, on any file system that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    fs, p = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = [n.removeprefix("batch=") for n in names if n.startswith("batch=")]
    return sorted(int(n) for n in found if n.isdigit() and fs.exists(_path(spark, f"{folder}/batch={n}/_SUCCESS")[1]))


def last(spark: SparkSession, folder: str) -> int | None:
    return max(batches(spark, folder), default=None)


def follows(spark: SparkSession, folder: str, batch_id: int) -> None:
    """An error where a batch isn't the first, the last one again, or the next: what it builds on is lost."""
    n = last(spark, folder)
    if batch_id not in ((0,) if n is None else (n, n + 1)):
        raise ValueError(f"batch {batch_id} doesn't follow {n} of {folder}")


def upto(spark: SparkSession, folder: str, n: int, after: int = -1) -> DataFrame:
    """Rows of the batches after one and up to another, with their batch."""
    rows = spark.read.option("basePath", folder).parquet(*(f"{folder}/batch={b}" for b in batches(spark, folder) if after < b <= n))
    return rows.withColumn("batch", F.col("batch").cast("bigint"))


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


_MADE: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table that is made once and read by all that follows, in a folder of its own under spark.checkpoint.dir, which driver and executors share; it stays until `release`.

    Where that is unset, local mode takes a temporary folder and a cluster gives an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that `written` has made in this application; results that aren't written elsewhere can't be read after it."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        drop(spark, path)
