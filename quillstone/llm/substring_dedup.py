"""Operator 2, substring dedup by level-wise doubling.

Windows of half the length are looked at first. Of the half windows inside each whole window only the one
with the smallest hash is kept (its anchor): equal windows have equal anchors, so nothing is lost, and
one in about half a window's words is left. Anchors that stand in one document alone are dropped. Around the
others, windows of twice the length are hashed, and those that are in several documents survive; each
gets the smallest doc_id it starts in. `repeats` goes on from there: the hashes of two surviving windows side by side
make the hash of one of twice the length, until no candidates survive.

Texts of one word sequence have the same windows, so they are hashed once, for the smallest id that has them; of the
others every window starts there. A row is known by its id and a hash of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Work, join_checked


def _sequences(batches):
    """Of each text: doc_id, t, words, and a hash of their sequence."""
    for b in W.chunks(batches, "text"):
        w = W.split(b.column(1))
        n = w.count
        with np.errstate(over="ignore"):
            place = W.mix(np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], n).astype(np.uint64) + np.uint64(1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(w.hash + place))])
            seq = W.mix(sums[w.first[1:]] - sums[w.first[:-1]] + n.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(seq.view(np.int64))], ["doc_id", "t", "n_words", "seq"])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width], for each i that has so many."""
    span, out = 1, x
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    if width > span:
        out = best(out[: len(x) - width + 1], out[width - span :])
    return out


def _anchors(length: int):
    """(h, doc_id, t, pos) of the half windows that are the smallest in some window."""
    half = length // 2
    run = length - half + 1

    def scan(batches):
        for b in W.chunks(batches, "text"):
            w = W.split(b.column(1))
            h, _ = W.long_windows(w, half)
            n = len(h)
            pick = np.zeros(n, bool)
            if n >= run:
                valid = np.arange(n) + length <= np.repeat(w.first[1:], w.count)
                low = np.where(valid[: n - run + 1], _sliding(h, run, np.minimum), np.uint64(0))
                pad = np.zeros(run - 1, np.uint64)
                pick = _sliding(np.concatenate([pad, low, pad]), run, np.maximum)[:n] == h
                # hash 0 would match the padding: such a window (one in 2^64) counts where it is not needed
            at = np.flatnonzero(pick)
            doc = w.doc()[at]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32))], ["h", "doc_id", "t", "pos"])

    return scan


def _hashes(length: int, before: int):
    """(h, doc_id, t, pos) of the windows that start at most `before` words before a place in `at`."""

    def scan(batches):
        for b in W.chunks(batches, "text"):
            w = W.split(b.column(1))
            h, ok = W.long_windows(w, length)
            places = b.column(3)
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(places.offsets)) if not places.null_count else [0 if x is None else len(x) for x in places.to_pylist()])
            at = places.flatten().to_numpy(zero_copy_only=False) + w.first[doc]
            seen = np.zeros(len(h) + 1, np.int32)
            np.add.at(seen, np.maximum(at - before, w.first[doc]), 1)
            np.add.at(seen, at + 1, -1)
            p = np.flatnonzero((np.cumsum(seen[:-1]) > 0) & ok)
            d = w.doc()[p]
            yield pa.RecordBatch.from_arrays([pa.array(h[p].view(np.int64)), b.column(0).take(pa.array(d)), b.column(2).take(pa.array(d)), pa.array((p - w.first[d]).astype(np.int32))], ["h", "doc_id", "t", "pos"])

    return scan


_ROWS = "h bigint, doc_id bigint, t bigint, pos int"
_ROW = ["doc_id", "t"]


def _places(work: Work, rows: DataFrame) -> DataFrame:
    """(doc_id, t, at) of (doc_id, t, pos). It grows with the documents, so joins with it always shuffle."""
    return work.write(rows.groupBy(*_ROW).agg(F.collect_list("pos").alias("at")), "places")


def _shared(work: Work, rows: DataFrame) -> DataFrame:
    """Rows whose hash is in several documents, with the smallest of them (low)."""
    rows = work.write(rows, "rows")
    # written, so that the rows of a hash which very many documents share can be split in the join
    ends = work.write(rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "low"), "ends")
    return rows.join(ends, "h").select("h", *_ROW, "pos", "low")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def _windows(work: Work, texts: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, t, pos, low) of all windows of `length` words that are in several of `texts`."""
    shared = _shared(work, texts.mapInArrow(_anchors(length), _ROWS))
    places = _places(work, shared)
    work.remove("rows", "ends")
    again = texts.join(places, _ROW).select("doc_id", "text", "t", "at")
    return _shared(work, again.mapInArrow(_hashes(length, length - length // 2), _ROWS))


def _doubled(work: Work, found: DataFrame, length: int) -> DataFrame:
    """Windows of twice the length that are in several documents, from two of `length` side by side; no text is read again."""
    after = found.select(F.col("h").alias("h2"), *_ROW, (F.col("pos") - length).alias("pos"))
    return _shared(work, found.select("h", *_ROW, "pos").join(after, [*_ROW, "pos"]).select(F.xxhash64("h", "h2").alias("h"), *_ROW, "pos"))


def repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(length, doc_id, pos): all windows that are in several documents, of `window` words and of its doublings until none survives.

    Null texts and ids have none; of repeated rows each has its own. Other columns are not read; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "repeats")
    texts = _texts(docs, id_col, text_col).where("doc_id is not null").dropDuplicates(_ROW)
    found, length, out = work.write(_windows(work, texts, window), "level"), window, None
    while not found.isEmpty():
        level = found.select(F.lit(length).alias("length"), "doc_id", "pos")
        out = level if out is None else out.union(level)
        found = work.write(_doubled(work, found, length), "level")
        length *= 2
    return docs.sparkSession.sql("select 0 as length, 0L as doc_id, 0 as pos where false") if out is None else out


def _kept(window: int):
    def scan(batches):
        for b in W.chunks(batches, "text"):
            w = W.split(b.column(1))
            n, words = w.count, len(w.hash)
            places = b.column(3)
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(places).to_pylist()], np.int64)
            doc = np.repeat(np.arange(b.num_rows), size)
            at = places.flatten().to_numpy(zero_copy_only=False) + w.first[doc]
            seen = np.zeros(words + 1, np.int64)
            np.add.at(seen, at, 1)
            np.add.at(seen, at + window, -1)
            gone = np.cumsum(seen[:-1]) > 0
            copy = np.asarray(b.column(4).fill_null(False))
            gone |= np.repeat(copy & (n >= window), n)
            kept = np.flatnonzero(~gone)
            owner = w.doc()[kept]
            more = np.concatenate([owner[1:] == owner[:-1], [False]])[: len(kept)]  # a space follows, in the place of what separated the words
            data = w.data.copy()
            data[w.end[kept[more]]] = 0x20
            edge = np.zeros(len(data) + 1, np.int8)
            edge[w.start[kept]] += 1
            edge[w.end[kept] + more] -= 1
            mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
            total = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
            text = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data[mask].tobytes())).cast(pa.string())
            removed = n - np.bincount(owner, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(removed), text], ["doc_id", "n_words", "n_removed", "text"])

    return scan


def deduplicate(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and text, the words left joined by one space.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller
    doc_id (words: runs without ASCII white space, unchanged). Windows are judged on the input. A null text
    has no words; a null id has no order, so its row keeps all words and takes none from others. Rows of
    one id take nothing from each other, and each is judged by its own text. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "substrings")
    texts = _texts(docs, id_col, text_col)
    named = texts.where("doc_id is not null")
    seqs = work.write(named.mapInArrow(_sequences, "doc_id bigint, t bigint, n_words bigint, seq bigint"), "seqs").where(F.col("n_words") >= window)
    first = work.write(seqs.groupBy("seq", "n_words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "first")
    copies = work.write(seqs.join(first, ["seq", "n_words"]).where("doc_id > low").select(*_ROW).distinct().withColumn("copy", F.lit(True)), "copies")
    apart = join_checked(named, copies, _ROW, "left_anti", 24 * copies.count()).select("doc_id", "text", "t")
    found = _windows(work, apart, window).where("low < doc_id").select(*_ROW, "pos")
    places = _places(work, found)
    work.remove("rows", "ends", "seqs", "first")
    marks = work.write(places.join(copies, _ROW, "full").select(*_ROW, "at", "copy"), "marks")
    work.remove("places", "copies")
    return texts.join(marks, _ROW, "left").select("doc_id", "text", "t", "at", "copy").mapInArrow(_kept(window), "doc_id bigint, n_words bigint, n_removed bigint, text string")


def op2_doubling_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
