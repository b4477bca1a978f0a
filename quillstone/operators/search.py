"""Lexical retrieval and text structure over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def term_frequencies(docs: DataFrame) -> DataFrame:
    """Documents that have each term."""
    return docs.select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings_search(docs: DataFrame, query: list[str]) -> DataFrame:
    """Sum of 1/df over the query's terms that a document has."""
    posts = docs.select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).where(F.col("term").isin(*query))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return posts.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.count("*").alias("matched"), F.round(F.sum(1 / F.col("df")), 9).alias("weight"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Runs of non-blank lines: index, first and last line, characters."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    blank = (T.normalize_text(F.col("s")) == "").cast("int")
    w = Window.partitionBy("doc_id").orderBy("line")
    island = lines.withColumn("island", F.sum(blank).over(w)).where(blank == 0)
    out = island.groupBy("doc_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum(F.length("s")).alias("n_chars"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1
    return out.select("doc_id", index.alias("paragraph"), "first_line", "last_line", "n_chars")


def shards(docs: DataFrame, size: int = 4096) -> DataFrame:
    """Tumbling windows of bytes."""
    n = F.octet_length("text")
    starts = docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("start_offset"))
    return starts.select("doc_id", "start_offset", F.least(F.col("n"), F.col("start_offset") + size).alias("end_offset"))


def checksum_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal normalised texts, two at least."""
    key = F.sha2(T.normalize_search(F.col("text")).cast("binary"), 256).alias("checksum")
    return docs.where("text is not null").groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 2")
