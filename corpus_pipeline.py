"""The training-data pipeline: toxic documents go, one document of each near-duplicate class stays, contaminated documents go, secrets are blanked out, and what is left is packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from quillstone.llm.labelled import fold
from quillstone.llm.store import Work


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches their language's threshold go; null and empty texts stay, repeated rows are judged each, all columns are kept, an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.remove_toxic(docs, labels, F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, the smallest id's, and of repeated rows one; rows without words or with a null id stay."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, with all rows of their id; rows with a null id or text stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets become [SECRET] and n_chars is counted again; a null text stays null, no row goes."""
    # the model of op6, counted on the whole table: a token has one verdict in both
    samples = secrets.default_samples(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return secrets.redact(docs, samples=samples).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens at most; a null or empty text is one token, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("packing", pack),
]

#: Classifiers, components and tokenizers are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
