"""Labelled texts for the classifiers: all of them, or bounded, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import join_checked


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


#: Bytes of text that the sample of either label may have.
BYTES_EACH = 64 << 20


def labelled(labels: DataFrame, label: str, unless: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): ids of rows where `unless` is false. A document with several labels takes the largest; null ids and labels are passed over."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return own.where(~unless).groupBy("doc_id").agg(F.max("label").alias("label"))


def distinct_texts(docs: DataFrame, labels: DataFrame, label: str, unless: Column, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """digest, text, label and `extra` of all distinct texts of labelled ids, 0 or 1; those of a text of several ids are the smallest id's. Null texts are passed over."""
    ids = labelled(labels, label, unless, id_col).where("label in (0, 1)")
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra)]
    texts = join_checked(docs.select(*columns).where("text is not null"), ids, "doc_id", "inner", ids.count() * 24)
    one = texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.min(F.struct("doc_id", "label", *extra)).alias("r"))
    return one.select("digest", "text", "r.label", *(F.col(f"r.`{c}`") for c in extra))


def picked(labels: DataFrame, label: str, rows_each: int, unless: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): at most `rows_each` ids of either label, the first by a hash, from rows where `unless` is false. A document with several labels takes the largest; null ids and labels are passed over."""
    own = labelled(labels, label, unless, id_col)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return own.where("label = 1").orderBy(*order).limit(rows_each).union(own.where("label = 0").orderBy(*order).limit(rows_each))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows_each: int, unless: Column, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), bytes_each: int = BYTES_EACH) -> list:
    """Distinct whole texts of the picked ids (doc_id, text, label and `extra`), of either label at most `rows_each` rows and `bytes_each` bytes.

    Null texts are passed over; of several rows of one id one is taken, whatever their order.
    """
    ids = picked(labels, label, rows_each, unless, id_col)
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra)]
    texts = docs.select(*columns).where("text is not null").join(F.broadcast(ids), "doc_id")  # at most 2 * rows_each ids are broadcast
    one = texts.groupBy("doc_id", "label").agg(F.min_by(F.struct("text", *extra), F.xxhash64("text", *extra)).alias("r")).select("doc_id", "label", "r.*")
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of the sample's rows alone
    rows = one.withColumn("so_far", so_far).where(F.col("so_far") <= bytes_each).drop("so_far").collect()
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        if r.text not in seen:
            seen.add(r.text)
            out.append(r)
    return out
