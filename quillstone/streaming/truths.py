"""The truth fold as a stream: each micro-batch meets the truths that were active after the one before.

A batch writes what it says of truths and the active ones it leaves, so its cost goes with its statements and the active truths of
the projects and kinds it touches; settled truths are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import truths as U
from ..sources import folders


def apply_batch(atoms: DataFrame, batch_id: int, target: str) -> None:
    """Folds the statements of a batch (see `operators.truths.atomize`) after all earlier batches; within it they are ordered as in `fold_truths`.

    A repeated batch replaces its own files; one that doesn't follow the last is an error.
    """
    spark = atoms.sparkSession
    folders.follows(spark, f"{target}/active", batch_id)
    features = U.truth_features(atoms)
    active = spark.read.parquet(f"{target}/active/batch={batch_id - 1}") if batch_id else None
    writes = f"{target}/writes/batch={batch_id}"
    U.fold_step(features, active).write.mode("overwrite").parquet(writes)
    U.still_active(features, spark.read.parquet(writes), batch_id, active).write.mode("overwrite").parquet(f"{target}/active/batch={batch_id}")
    folders.drop(spark, f"{target}/active/batch={batch_id - 2}")


def truths(spark: SparkSession, target: str) -> DataFrame:
    """All truths after the last whole batch, as `fold_truths` gives them."""
    n = folders.last(spark, f"{target}/active")
    if n is None:
        raise ValueError(f"no truths at {target}")
    return U.truths_of(folders.upto(spark, f"{target}/writes", n), F.struct("batch", "ord"))


def fold(spark: SparkSession, source: str, target: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query over Parquet files of conversations (conv_id, turn, role, text), a file having whole conversations; the caller awaits it."""
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(lambda b, i: apply_batch(U.atomize(b), i, target)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
