"""An inverted index of records, kept up to date from touched records only.

The index is two tables: `postings` (record_id, term, n), how often a record says a term, and `frequencies` (term, df), how many records do.
On disk (`apply_batch`) both are added to, never rewritten: a batch leaves the postings of what it touched, its ids, and signed changes of frequencies.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders
from . import records


class Index(NamedTuple):
    postings: DataFrame
    frequencies: DataFrame


#: What each byte of a text is to its words: lower-cased, or a blank for what parts them (bytes of other alphabets too).
_FOLDED = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256)], np.uint8)
#: Bytes of text that are taken apart at once (one longer text is taken alone), and characters that a word has at least.
_BYTES, _LEAST = 4 << 20, 3


def _chunk(offsets: np.ndarray, folded: np.ndarray) -> pa.ListArray:
    """Of some texts, given by their folded bytes and where each begins, the words with their numbers."""
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(folded)]))
    words, places = lists.flatten(), pc.list_parent_indices(lists)
    kept = pc.greater_equal(pc.binary_length(words), _LEAST)
    named = words.filter(kept).dictionary_encode()
    kinds = max(1, len(named.dictionary))
    pairs, n = np.unique(places.filter(kept).to_numpy() * kinds + named.indices.to_numpy(), return_counts=True)
    said = pa.StructArray.from_arrays([named.dictionary.take(pa.array(pairs % kinds)).cast(pa.string()), pa.array(n.astype(np.int64))], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // kinds, np.arange(len(offsets))).astype(np.int32)), said)


def _counted(texts: pa.Array) -> pa.Array:
    """The distinct words of each text with their numbers."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    data, at = texts.buffers()[2] or b"", int(np.frombuffer(texts.buffers()[1], np.int64, 1, texts.offset * 8)[0]) if len(texts) else 0
    out, first = [], 0
    while first < len(ends):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _BYTES, "right")))
        offsets = np.concatenate([[0], ends[first:last] - done]).astype(np.int64)
        out.append(_chunk(offsets, _FOLDED[np.frombuffer(data, np.uint8, int(offsets[-1]), at + done)]))
        first = last
    return pa.concat_arrays(out) if out else _chunk(np.zeros(1, np.int64), np.zeros(0, np.uint8))


def postings(rows: DataFrame) -> DataFrame:
    """(record_id, term, n) of rows with record_id and text; a record's rows count together. A null or empty text has none, nor has a row without an id.

    Terms are the words of `text.ascii_words`. Texts are dealt by record, so words are made on all cores and counted where they are made: no word is shuffled.
    """
    counted = F.arrow_udf(_counted, "array<struct<term:string,n:bigint>>")
    own = rows.where("record_id is not null").groupBy("record_id").agg(F.array_join(F.collect_list(F.col("text").cast("string")), " ").alias("text"))  # the texts of one record
    return own.select("record_id", F.inline(counted("text")))


def built(rows: DataFrame) -> Index:
    """The index of records, each once, built anew."""
    own = postings(rows)
    return Index(own, own.groupBy("term").agg(F.count("*").alias("df")))


def last_words(touched: DataFrame) -> DataFrame:
    """Of the rows (record_id, clock, text) of a record the one with the highest clock, then the highest SHA-256 of its text; rows without an id are passed over."""
    return records.latest(touched.where("record_id is not null").select("record_id", "clock", "text"), ["record_id"], [F.col("clock"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)])


def changes(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(term, df): by how much each term's frequency changes when some postings go and others come; terms that stay as they are have no row."""
    signed = gone.select("term", F.lit(-1).alias("one")).union(come.select("term", F.lit(1).alias("one")))
    return signed.groupBy("term").agg(F.sum("one").alias("df")).where("df <> 0")


def updated(index: Index, touched: DataFrame) -> Index:
    """The index after a batch of upserts and deletions (a null text): the old postings of touched records go, new ones come, and only their terms change frequency."""
    last = last_words(touched)
    ids, come = touched.where("record_id is not null").select("record_id").distinct(), postings(last)
    gone = index.postings.join(ids, "record_id", "left_semi")
    summed = index.frequencies.union(changes(gone, come)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return Index(index.postings.join(ids, "record_id", "left_anti").union(come), summed)


def apply_batch(touched: DataFrame, batch_id: int, target: str) -> None:
    """Adds a batch (record_id, clock, text) to the index under `target`: for use with foreachBatch, or alone.

    What a batch says comes after all of the batches before it. A repeated batch replaces its own files; one that doesn't follow the last is an error. A
    record's terms are held beside its id, so old ones are found without the postings.
    """
    spark = touched.sparkSession
    folders.follows(spark, f"{target}/frequencies", batch_id)
    if touched.select("record_id").schema[0].dataType.typeName() not in ("string", "long", "integer"):
        raise ValueError("record_id must be a string or an integer")
    last = last_words(touched)
    said, ids = f"{target}/postings/batch={batch_id}", f"{target}/records/batch={batch_id}"
    postings(last).write.mode("overwrite").parquet(said)
    come = spark.read.parquet(said)
    own = come.groupBy("record_id").agg(F.collect_list("term").alias("terms"))  # the terms of one record
    last.select("record_id").join(own, "record_id", "left").write.mode("overwrite").parquet(ids)
    now = spark.read.parquet(ids).select("record_id")
    gone = come.limit(0)
    if batch_id > 0:
        known = folders.upto(spark, f"{target}/records", batch_id - 1).join(now, "record_id", "left_semi")
        gone = records.latest(known, ["record_id"], [F.col("batch")]).select(F.explode("terms").alias("term"))
    changes(gone, come).write.mode("overwrite").parquet(f"{target}/frequencies/batch={batch_id}")


def index(spark: SparkSession, target: str) -> Index:
    """The index under `target` after its last whole batch."""
    n = folders.last(spark, f"{target}/frequencies")
    if n is None:
        raise ValueError(f"no index at {target}")
    newest = folders.upto(spark, f"{target}/records", n).groupBy("record_id").agg(F.max("batch").alias("batch"))
    own = folders.upto(spark, f"{target}/postings", n).join(newest, ["record_id", "batch"], "left_semi").drop("batch")
    df = folders.upto(spark, f"{target}/frequencies", n).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return Index(own.select("record_id", "term", "n"), df)
