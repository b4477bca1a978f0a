"""Record tables: scans, latest-wins merges, change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in sorted(tables.items())]
    return reduce(DataFrame.unionByName, one)


def page(table: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return table.orderBy(key).offset(offset).limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key, the last in an order that must be total; combined before the shuffle, so a hot key is a row a task."""
    own = rows.select(*keys, F.struct(*(F.coalesce(o, o).alias(f"o{i}") for i, o in enumerate(order))).alias("__order"), F.struct(*rows.columns).alias("__row"))
    return own.groupBy(*keys).agg(F.max_by("__row", "__order").alias("__row")).select("__row.*")


def merge(local: DataFrame, incoming: DataFrame, key: str, clock: str, payload: str) -> DataFrame:
    """Last writer wins by clock, then by the payload's SHA-256: the same from whichever side it is called."""
    return latest(local.unionByName(incoming), [key], [F.col(clock), F.sha2(F.col(payload).cast("binary"), 256)])


def mutation_log(events: DataFrame) -> DataFrame:
    """Events as a change log: their user is the origin, their rank there the sequence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("origin"), F.row_number().over(w).cast("bigint").alias("sequence"), "event_id", F.sha2(F.col("props").cast("binary"), 256).alias("payload_hash"), "ts")


def gaps(log: DataFrame) -> DataFrame:
    """Entries whose sequence isn't their predecessor's successor; an origin's first entry may be any."""
    before = F.lag("sequence").over(Window.partitionBy("origin").orderBy("sequence"))
    return log.withColumn("before", before).where("before is not null and sequence > before + 1").select("origin", "sequence", "before")


def manifests(log: DataFrame, size: int = 32) -> DataFrame:
    """Batches of at most `size` entries of an origin, each with the SHA-256 of its entries in order."""
    line = F.struct("sequence", F.concat_ws(":", F.col("sequence").cast("string"), F.col("event_id").cast("string"), "payload_hash").alias("line"))
    out = log.groupBy("origin", F.floor((F.col("sequence") - 1) / size).alias("batch")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))
    return out.select("origin", "batch", "n", F.sha2(F.array_join("lines.line", "|").cast("binary"), 256).alias("manifest"))


def cursors(log: DataFrame) -> DataFrame:
    return log.groupBy("origin").agg(F.max("sequence").alias("cursor"))


#: Hexadecimal digits that name a leaf of a tree of hashes: 65,536 leaves.
LEAF_DIGITS = 4


def hash_tree(values: DataFrame, digits: int = LEAF_DIGITS) -> DataFrame:
    """(prefix, n, hash): a tree over a set of SHA-256 in hexadecimal. A leaf is the hash of its distinct values, sorted and joined by |; an inner node, one digit shorter, that of its children's.

    Two sets differ where their leaves do (`differing_leaves`); a leaf has about 1 / 16^`digits` of the values, whatever these are hashes of, and
    a change of the set changes one node of each level. Nulls are passed over; an empty set has no nodes.
    """
    return reduce(DataFrame.union, _levels(values, digits))


def _levels(values: DataFrame, digits: int) -> list[DataFrame]:
    level = values.select(F.col(values.columns[0]).alias("h")).where("h is not null").distinct().groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.count("*").alias("n"), _joined(F.col("h")))
    levels = [level]
    for d in reversed(range(digits)):
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sum("n").alias("n"), _joined(F.col("hash"), F.col("prefix")))
        levels.append(level)
    return levels


def _joined(value: Column, by: Column | None = None) -> Column:
    rows = F.array_sort(F.collect_list(value if by is None else F.struct(by.alias("by"), value.alias("value"))))
    return F.sha2(F.array_join(rows if by is None else rows["value"], "|").cast("binary"), 256).alias("hash")


def differing_leaves(ours: DataFrame, theirs: DataFrame, digits: int = LEAF_DIGITS) -> DataFrame:
    """(prefix, ours, theirs): leaves of two trees that differ, with how many values each side has under them; values to exchange begin so."""
    side = lambda t, name: t.where(F.length("prefix") == digits).select("prefix", F.col("n").alias(name), F.col("hash").alias(f"{name}_hash"))
    both = side(ours, "ours").join(side(theirs, "theirs"), "prefix", "full_outer").where(~F.col("ours_hash").eqNullSafe(F.col("theirs_hash")))
    return both.select("prefix", F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))


def set_root(values: DataFrame) -> DataFrame:
    """One row, root: the top hash of the tree of a column's values (`hash_tree`), or of their SHA-256 where they are no such hashes; null where there are none. Only tasks hash."""
    own = values.select(F.col(values.columns[0]).alias("h"))
    hashes = own.select(F.when(F.col("h").rlike("^[0-9a-f]{64}$"), F.col("h")).otherwise(F.sha2(F.col("h").cast("binary"), 256)).alias("h"))
    return _levels(hashes, LEAF_DIGITS)[-1].agg(F.max("hash").alias("root"))


def without(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't deleted."""
    return table.join(deleted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(table.columns)


def new_mutations(incoming: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Incoming entries that the log doesn't have, each once."""
    return incoming.dropDuplicates([key]).join(log.select(key), key, "left_anti").select(incoming.columns)


def pending(log: DataFrame, cursor: int, n: int = 32) -> DataFrame:
    """The next n entries after a cursor; the limit is the batch's."""
    return log.where(F.col("sequence") > cursor).orderBy("sequence", "origin").limit(n)


def in_sequence(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries with accepted: those that follow their origin's cursor (seen: origin, cursor) without a gap; after a gap none is, and an origin not seen may begin anywhere."""
    w = Window.partitionBy("origin").orderBy("sequence")
    rows = log.join(seen, "origin", "left").where(F.col("cursor").isNull() | (F.col("sequence") > F.col("cursor")))
    before = F.coalesce(F.lag("sequence").over(w), "cursor", F.col("sequence") - 1)
    rows = rows.withColumn("broken", (F.col("sequence") != before + 1).cast("int"))
    return rows.withColumn("accepted", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("broken", "cursor")


def advanced(seen: DataFrame, log: DataFrame) -> DataFrame:
    """Cursors that never go back."""
    both = seen.select("origin", "cursor").union(log.groupBy("origin").agg(F.max("sequence").alias("cursor")).select("origin", "cursor"))
    return both.groupBy("origin").agg(F.max("cursor").alias("cursor"))


def versions(rows: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    """Each row's version within its key, from 1, and the id of the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"version": F.row_number().over(w), "rollback": F.lag(ident).over(w)})


def merge_clock(*fields: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(F.when(F.trim(f.cast("string")) != "", f.cast("string")) for f in fields), F.lit(""))


def merged_roots(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(a, b))))
