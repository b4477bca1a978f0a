"""Messages: roles, ordinals, exchanges, blocks, statements and the patterns they recur in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BLOCK = 250
PATTERN_KINDS = ("decision", "constraint", "fact", "task", "idea")


def messages(conversations: DataFrame) -> DataFrame:
    """Non-empty turns with normalised roles, numbered from 0 within their conversation."""
    rows = conversations.where(T.normalize_text(F.col("text")) != "")
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("sequence"), T.role(F.col("role")).alias("role"), "text")


def spoken(rows: DataFrame, include_system: bool = False) -> DataFrame:
    kept = rows.where(T.normalize_text(F.col("text")) != "")
    return kept if include_system else kept.where(~F.lower("role").isin("system", "tool"))


def summaries(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(T.word_count(F.col("text"))).cast("bigint").alias("word_count"))


def exchanges(rows: DataFrame) -> DataFrame:
    """Running number of user turns, 1 at least."""
    w = Window.partitionBy("conv_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "sequence", F.greatest(F.lit(1), F.sum((F.col("role") == "user").cast("int")).over(w)).cast("bigint").alias("exchange"))


def topic_parts(rows: DataFrame, most: int = 100) -> DataFrame:
    return rows.groupBy("conv_id", F.floor(F.col("sequence") / most).alias("part")).agg(F.count("*").alias("n_messages"))


def statements(rows: DataFrame) -> DataFrame:
    """A row for each sentence, with its kind, subject, value, polarity and keywords."""
    each = rows.select("conv_id", "sequence", "role", F.posexplode(T.sentences(F.col("text"))).alias("index", "sentence"))
    words = T.ascii_words(F.col("sentence"))
    subject = F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 8), " ")).otherwise(F.col("sentence"))
    kind = T.statement_kind(F.col("sentence"))
    return each.select(
        "conv_id", "sequence", "role", "index", "sentence", kind.alias("kind"), subject.alias("subject"),
        T.statement_value(F.col("sentence"), kind).alias("value"), T.polarity(F.col("sentence")).alias("polarity"), F.array_join(F.slice(words, 1, 12), " ").alias("keywords"),
    )


def pattern_key():
    words = F.array_sort(F.slice(F.split("subject", " "), 1, 4))
    return F.concat(F.col("kind"), F.lit(":"), F.array_join(words, "-"))


def patterns(atoms: DataFrame) -> DataFrame:
    """Statements by kind and leading subject words, three at least, with strength and status. Conversations stand for projects."""
    n, projects = F.count("*").alias("n"), F.count_distinct("conv_id").alias("projects")
    found = atoms.where(F.col("kind").isin(*PATTERN_KINDS)).groupBy(pattern_key().alias("pattern_key")).agg(n, projects).where("n >= 3")
    strength = T.clamp(0.28 + F.log2(F.col("n") + 1) / 9 + F.least(F.lit(0.24), 0.06 * F.col("projects")))
    wide = F.col("projects") >= 2
    status = F.when((F.col("n") >= 12) & wide, "TESTING").otherwise("CANDIDATE")
    maturity = F.when((F.col("n") >= 7) & wide, "L3_HYPOTHESIS").otherwise("L2_CANDIDATE")
    return found.select("pattern_key", "n", "projects", F.round(strength, 6).alias("strength"), status.alias("status"), maturity.alias("maturity"))
