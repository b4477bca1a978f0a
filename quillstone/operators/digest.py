"""Markdown digests of conversations, their summaries and number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import conversations as C


def escaped(c: Column) -> Column:
    """Markdown signs that would change a line's meaning, with a backslash before them."""
    return F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1")


def cell(c: Column) -> Column:
    """Text for a table's cell: bars escaped, lines joined."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def demoted(c: Column, by: int = 2) -> Column:
    """Headings of a text, `by` levels lower."""
    return F.regexp_replace(c, r"(?m)^(#{1,6}) ", "#" * by + "$1 ")


def file_name(c: Column) -> Column:
    """A file's name for a title: letters, digits and _, 64 at most."""
    s = F.trim(F.regexp_replace(F.regexp_replace(T.lower_ascii(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", "conversation").otherwise(F.substring(s, 1, 64))


def role_label(role: Column) -> Column:
    return F.when(role == "user", "User").when(role == "assistant", "Assistant").when(role == "system", "System").when(role == "tool", "Tool").otherwise(F.initcap(role))


def parts(messages: DataFrame, most: int = 100) -> DataFrame:
    """Each conversation in parts of `most` messages: its file's path and Markdown. A part is bounded by its messages."""
    body = F.concat(F.lit("### "), role_label(F.col("role")), F.lit("\n\n"), demoted(F.col("text")), F.lit("\n"))
    rows = messages.withColumns({"part": F.floor(F.col("sequence") / most), "body": body})
    one = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "body"))), lambda x: x["body"]), "\n").alias("text"))
    title = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    path = F.concat(F.lit("topics/"), file_name(title), F.lit("_"), F.lpad((F.col("part") + 1).cast("string"), 3, "0"), F.lit(".md"))
    return one.select("conv_id", "part", "n", path.alias("path"), F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("text")).alias("content"))


def summary(messages: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row: paragraphs (messages), statements and threads."""
    return messages.agg(F.count("*").alias("paragraphs"), F.count_distinct("conv_id").alias("threads")).crossJoin(atoms.agg(F.count("*").alias("atoms")))  # two single rows


def thread_atoms(messages: DataFrame, atoms: DataFrame) -> DataFrame:
    """Statements of each thread, and of each of its parts, pro rata, rounded up."""
    n = atoms.groupBy("conv_id").agg(F.count("*").alias("atoms"))
    size = C.summaries(messages).select("conv_id", "message_count")
    each = C.topic_parts(messages, 3).join(size, "conv_id").join(n, "conv_id", "left")
    return each.select("conv_id", "part", "n_messages", F.coalesce("atoms", F.lit(0)).alias("atoms"), F.ceil(F.coalesce("atoms", F.lit(0)) * F.col("n_messages") / F.col("message_count")).alias("part_atoms"))


def bytes_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one digit."""

    def over(k):
        tenths = F.floor((n * 10 + (1 << (k - 1))) / (1 << k))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(over(10), F.lit(" KB"))).when(n < 1 << 30, F.concat(over(20), F.lit(" MB"))).otherwise(F.concat(over(30), F.lit(" GB")))


def duration_text(ms: Column) -> Column:
    s, tenths = F.floor(ms / 1000), F.floor((ms + 50) / 100)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(s < 60, short).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" m "), (s % 60).cast("string"), F.lit(" s")))


def compression(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((1 - after / before) * 100, 6)).otherwise(0.0)


def manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines `name=value` of each row, with backslashes, line ends and tabs escaped."""
    def clean(c):
        out = c.cast("string")
        for sign, to in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(sign), F.lit(to))
        return out

    return rows.select(*columns[:1], F.concat_ws("\n", *(F.concat(F.lit(f"{c}="), F.coalesce(clean(F.col(c)), F.lit(""))) for c in columns[1:])).alias("manifest"))
