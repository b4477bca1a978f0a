"""Written tables in the cluster's shared folder, and joins with a side of checked size.

Operators cut lineage by writing tables; an empty table is written and read like any other. What a lazy
result still reads stays until `release` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times bytes a row up to which a side is broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 24 << 20


#: Spark's own setting: shuffle files go when the query that made them ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: dict[str, list[str]] = {}
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows a batch to `BATCH_ROWS` (a lower one stays): with Spark's 10000, one batch of long texts fills what an executor has beside its heap."""
    rows = int(spark.conf.get(_ROWS, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: one of its own in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators have written in this application; results not yet written elsewhere can't be read after it."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Work:
    """A folder for the tables that one operator writes; drop() and remove() delete those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", []
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.made)}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: str) -> None:
        """Deletes all written tables but the named ones."""
        self.remove(*{self._name(p) for p in self.made} - set(keep))

    def remove(self, *names: str) -> None:
        for path in [p for p in self.made if self._name(p) in names]:
            self.delete(path)
            self.made.remove(path)

    def delete(self, path: str) -> None:
        _delete(self.spark, path)

    @staticmethod
    def _name(path: str) -> str:
        return path.rsplit("/", 1)[1].rsplit("-", 1)[0]


def join_checked(big: DataFrame, side: DataFrame, on: str | list[str], how: str, side_bytes: int) -> DataFrame:
    """Broadcasts a side whose measured size is small, else leaves the join to shuffles."""
    return big.join(F.broadcast(side) if side_bytes <= BROADCAST_BYTES else side, on, how)
