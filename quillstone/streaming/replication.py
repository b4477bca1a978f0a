"""Consumes a change log as a stream: entries are verified, repeats dropped, gaps and broken chains rejected, and the latest of each key kept.

A micro-batch writes the records it changes and the cursors it leaves, under its own number, so a repeated batch replaces its own. Each
`COMPACTED`th batch writes all records, and what came before the last such state is dropped.

Entries have origin, sequence, record_id, payload and payload_hash. Those of a chained log also have memory_root, type, entity_type, parents and hash: their
envelope's hash covers all of these, and the parents of an entry name its origin's entry before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import folders

#: So many batches lie between two states that are written whole.
COMPACTED = 16

PLAIN = ("origin", "sequence", "record_id", "payload", "payload_hash")
CHAINED = (*PLAIN, "memory_root", "type", "entity_type", "parents", "hash")


def payload_hash() -> Column:
    """A deletion has no payload and the hash of the empty text."""
    return F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256)


def envelope_hash() -> Column:
    """SHA-256 of an entry's fields but its payload, as JSON with keys in order; fields that are null are null there, no parents are an empty list."""
    c = F.col
    none = F.array().cast("array<string>")
    fields = F.struct(
        c("record_id").alias("entityId"), c("entity_type").alias("entityType"), c("memory_root").alias("memoryRoot"), c("origin").alias("originDeviceId"), c("sequence").alias("originSequence"),
        F.coalesce("parents", none).alias("parents"), c("payload_hash").alias("payloadHash"), "type",
    )
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)


def reviewed(entries: DataFrame, root: str | None = None) -> DataFrame:
    """Entries with reason: null where an entry is what its hashes say, else the first of `missing` (origin, sequence or record), `root` (not the expected one), `payload` or `envelope`."""
    wrong = F.when(F.col("origin").isNull() | F.col("sequence").isNull() | F.col("record_id").isNull(), "missing")
    if root is not None:
        wrong = wrong.when(~F.col("memory_root").eqNullSafe(F.lit(root)), "root")
    wrong = wrong.when(~F.col("payload_hash").eqNullSafe(payload_hash()), "payload")
    if "hash" in entries.columns:
        wrong = wrong.when(~F.col("hash").eqNullSafe(envelope_hash()), "envelope")
    return entries.withColumn("reason", wrong)


def verified(entries: DataFrame) -> DataFrame:
    return reviewed(entries).where("reason is null").drop("reason")


def chained(entries: DataFrame, seen: DataFrame, ordered: bool = True) -> DataFrame:
    """Entries after their origin's cursor (seen: origin, cursor, head) with reason: `gap` where the one before is missing, `parent` where the parents don't name it, `waiting` after such a one, else null.

    An origin not seen may begin anywhere. Without `ordered` gaps are taken, and only an entry that follows another at once must name it.
    """
    w = Window.partitionBy("origin").orderBy("sequence")
    rows = entries.join(seen, "origin", "left").where(F.col("cursor").isNull() | (F.col("sequence") > F.col("cursor")))
    before = F.coalesce(F.lag("sequence").over(w), "cursor")
    follows = before.isNull() | (F.col("sequence") == before + 1)
    rows = rows.withColumn("follows", follows)
    wrong = F.when(~F.col("follows"), "gap") if ordered else F.when(F.lit(False), "gap")
    if "hash" in entries.columns:
        rows = rows.withColumn("head", F.coalesce(F.lag("hash").over(w), "head"))
        named = F.coalesce(F.array_contains("parents", F.col("head")), F.lit(False))
        wrong = wrong.when(F.col("head").isNotNull() & F.col("follows") & ~named, "parent")
    rows = rows.withColumn("reason", wrong).drop("follows", "head", "cursor")
    earlier = F.coalesce(F.max(F.col("reason").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("earlier", earlier).withColumn("reason", F.when(F.col("earlier"), "waiting").otherwise(F.col("reason"))).drop("earlier")


def _latest(rows: DataFrame) -> DataFrame:
    return R.latest(rows.select(*PLAIN), ["record_id"], [F.col("sequence"), F.col("origin"), F.col("payload_hash")])


def _state(spark: SparkSession, target: str, n: int) -> DataFrame | None:
    """All records after batch n: the last state written whole and the changes since."""
    base = max((b for b in folders.batches(spark, f"{target}/state") if b <= n), default=-1)
    parts = [spark.read.parquet(f"{target}/state/batch={base}")] if base >= 0 else []
    parts += [folders.upto(spark, f"{target}/changes", n, base)] if base < n else []
    rows = [p.select(*PLAIN) for p in parts]
    return _latest(rows[0] if len(rows) == 1 else rows[0].union(rows[1])) if rows else None


def apply_batch(batch: DataFrame, batch_id: int, target: str, ordered: bool = True, root: str | None = None) -> None:
    """One micro-batch. What isn't taken is in `rejected`, with its reason: forged entries, and with `ordered` those after a gap of their origin, to be sent again.

    Of two valid entries of one origin and sequence the one with the smaller hash counts. A chained log is checked against `root` if one is given. A batch that
    doesn't follow the last one is an error: the state before it would be lost.
    """
    spark = batch.sparkSession
    folders.follows(spark, f"{target}/cursors", batch_id)
    columns = CHAINED if "hash" in batch.columns else PLAIN
    own = reviewed(batch.select(*columns), root)
    if batch_id:
        seen = spark.read.parquet(f"{target}/cursors/batch={batch_id - 1}")
    else:
        seen = own.limit(0).select("origin", F.col("sequence").alias("cursor"), F.col("payload_hash").alias("head"))
    by_hash = [F.col("hash" if "hash" in columns else "payload_hash"), F.col("record_id")]
    once = own.where("reason is null").drop("reason")
    rest = [c for c in columns if c not in ("origin", "sequence")]
    once = once.groupBy("origin", "sequence").agg(F.min_by(F.struct(*rest), F.struct(*(b.alias(f"o{i}") for i, b in enumerate(by_hash)))).alias("e")).select("origin", "sequence", "e.*").select(*columns)
    checked = f"{target}/checked/batch={batch_id}"
    chained(once, seen, ordered).unionByName(own.where("reason is not null")).write.mode("overwrite").parquet(checked)
    rows = spark.read.parquet(checked)
    taken = rows.where("reason is null")
    _latest(taken).write.mode("overwrite").parquet(f"{target}/changes/batch={batch_id}")
    rows.where("reason is not null").write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
    if batch_id % COMPACTED == COMPACTED - 1:
        _state(spark, target, batch_id).write.mode("overwrite").parquet(f"{target}/state/batch={batch_id}")
    head = F.max_by("hash", "sequence") if "hash" in columns else F.lit(None).cast("string")
    now = taken.groupBy("origin").agg(F.max("sequence").alias("cursor"), head.alias("head"))
    both = seen.select("origin", "cursor", "head").union(now)
    both.groupBy("origin").agg(F.max_by("head", "cursor").alias("head"), F.max("cursor").alias("cursor")).write.mode("overwrite").parquet(f"{target}/cursors/batch={batch_id}")
    for part, keep in (("cursors", 1), ("checked", 1), ("state", COMPACTED), ("changes", 2 * COMPACTED)):
        for old in folders.batches(spark, f"{target}/{part}"):
            if old < batch_id - keep:
                folders.drop(spark, f"{target}/{part}/batch={old}")


def replicate(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, trigger: dict | None = None, ordered: bool = True, root: str | None = None):
    """Starts a query over Parquet files of entries; the caller awaits it."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda b, i: apply_batch(b, i, target, ordered, root)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _newest(spark: SparkSession, target: str) -> int:
    n = folders.last(spark, f"{target}/cursors")
    if n is None:
        raise ValueError(f"no batch at {target}")
    return n


def state(spark: SparkSession, target: str) -> DataFrame:
    """The latest payload of each record; deleted ones (a null payload) are not among them."""
    return _state(spark, target, _newest(spark, target)).where("payload is not null")


def cursors(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/cursors/batch={_newest(spark, target)}")


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """What the last batch didn't take, with its reason."""
    return spark.read.parquet(f"{target}/rejected/batch={_newest(spark, target)}")
