"""Chat exports of several providers as one table of messages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .archives import read_files

_COLUMNS = ("provider", "conversation_id", "title", "sequence", "role", "text")
CHAT_MESSAGES = "uuid string, name string, created_at string, chat_messages array<struct<uuid:string,sender:string,text:string>>"
PARTS = "id string, title string, messages array<struct<id:string,role:string,parts:array<struct<text:string>>>>"
ENVELOPE = "format string, version int, provider string, sourceLabel string, conversationExternalId string, conversationTitle string, messages array<struct<externalId:string,sequence:int,role:string,text:string>>"


def _numbered(rows: DataFrame) -> DataFrame:
    """Drops empty messages; what is left is numbered within its conversation by the place it had."""
    rows = rows.where(T.normalize_text(F.col("text")) != "")
    order = Window.partitionBy("provider", "conversation_id").orderBy("place")
    return rows.withColumns({"sequence": F.row_number().over(order) - 1, "role": T.role(F.col("role"))}).select(*_COLUMNS)


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of conversations with `chat_messages`. A file that isn't such an array is an error."""
    rows = spark.read.schema(CHAT_MESSAGES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = rows.select(F.lit("claude").alias("provider"), F.col("uuid").alias("conversation_id"), F.col("name").alias("title"), F.posexplode("chat_messages").alias("place", "m"))
    return _numbered(each.select("provider", "conversation_id", "title", "place", F.col("m.sender").alias("role"), F.col("m.text").alias("text")))


def part_messages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of conversations whose messages have `parts`."""
    rows = spark.read.schema(PARTS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = rows.select(F.lit("gemini").alias("provider"), F.col("id").alias("conversation_id"), "title", F.posexplode("messages").alias("place", "m"))
    return _numbered(each.select("provider", "conversation_id", "title", "place", F.col("m.role").alias("role"), F.array_join("m.parts.text", "\n").alias("text")))


def envelope_messages(spark: SparkSession, path: str, format_name: str) -> DataFrame:
    """Source envelopes of the named format, version 2; other files give no rows."""
    rows = spark.read.schema(ENVELOPE).option("multiLine", True).json(path).where((F.col("format") == format_name) & (F.col("version") == 2))
    each = rows.select(F.lower("provider").alias("provider"), F.coalesce("conversationExternalId", F.lit("conversation")).alias("conversation_id"), F.coalesce("conversationTitle", F.lit("Conversation")).alias("title"), F.posexplode("messages").alias("place", "m"))
    return _numbered(each.select("provider", "conversation_id", "title", "place", F.col("m.role").alias("role"), F.col("m.text").alias("text")))


# Where text, roles, ids and times of a message are looked for, in this order, and names that hint at a provider.
TEXT_KEYS = ("text", "content", "parts", "message", "body", "value", "response", "prompt")
ROLE_KEYS, ID_KEYS = ("role", "sender", "author", "speaker", "from"), ("id", "uuid", "message_id", "messageId")
TIME_KEYS = ("create_time", "created_at", "createdAt", "timestamp", "time", "occurredAt")
ROOT_KEYS, LIST_KEYS = ("conversations", "chats", "threads", "items"), ("messages", "chat_messages", "turns", "entries")
HINTS = (("claude", ("claude", "anthropic")), ("gemini", ("gemini", "bard")), ("copilot", ("copilot", "bing")), ("poe", ("poe",)), ("perplexity", ("perplexity",)), ("chatgpt", ("chatgpt", "openai")))
PROVIDERS = (("chatgpt", ("chatgpt",), "openai"), ("claude", ("claude", "anthropic"), ""), ("gemini", ("gemini", "bard"), "google"), ("copilot", ("copilot", "bing"), "microsoft"), ("poe", ("poe",), ""), ("perplexity", ("perplexity",), ""))


def provider(c: Column) -> Column:
    """A provider's one name; others keep theirs, cleaned, and none is generic."""
    low, out = F.lower(F.trim(c)), None
    for name, parts, exact in PROVIDERS:
        found = F.lit(False)
        for p in parts:
            found = found | low.contains(p)
        found = found | (low == exact) if exact else found
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.when(F.coalesce(low, F.lit("")) == "", "generic").otherwise(F.regexp_replace(low, "[^a-z0-9_-]+", "_"))


def provider_hint(name: Column) -> Column:
    """The provider that a file's name speaks of, if any."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for label, parts in reversed(HINTS):
        found = F.lit(False)
        for p in parts:
            found = found | low.contains(p)
        out = F.when(found, label).otherwise(out)
    return out


def first_string(json: Column, keys: tuple[str, ...]) -> Column:
    """The first of some fields that is a non-empty scalar."""
    def scalar(k):
        v = F.trim(F.get_json_object(json, f"$.{k}"))
        return F.when((v != "") & ~v.rlike(r"^[\[{]"), v)

    return F.coalesce(*(scalar(k) for k in keys))


def is_array(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\x{feff}?\s*\["), F.lit(False))


def is_object(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\x{feff}?\s*\{"), F.lit(False))


def elements(c: Column) -> Column:
    """The elements of a JSON array, as JSON; none of anything else."""
    return F.when(is_array(c), F.from_json(F.regexp_replace(c, r"^\x{feff}", ""), "array<string>")).otherwise(F.array().cast("array<string>"))


def _extracted(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (str, int, float)):
        return str(value)
    if isinstance(value, list):
        return "\n".join(t for t in map(_extracted, value) if t.strip())
    if isinstance(value, dict):
        return next((t for t in (_extracted(value[k]) for k in TEXT_KEYS if k in value) if t.strip()), "")
    return ""


def _texts(messages: pd.Series) -> pd.Series:
    def one(m):
        try:
            return _extracted(json.loads(m))
        except (TypeError, ValueError):
            return ""

    return messages.map(one)


def extract_text(messages: Column | str) -> Column:
    """The text of JSON messages of any depth: known fields in order, lists joined by lines; roles and other fields are no text."""
    return F.pandas_udf(_texts, "string")(messages)


def conversations_of(files: DataFrame, envelope: str = "SOURCE_ENVELOPE") -> DataFrame:
    """(name, hint, place, conversation JSON) of files (name, content): a root may be a list, an object with a list of a known name, an envelope or one conversation. Files that are neither have none.

    Where a file comes in several rows, `first` is the place of a row's first element in the file.
    """
    c = F.col
    first = c("first") if "first" in files.columns else F.lit(0)
    hint = F.coalesce(provider_hint(c("name")), F.when(is_object(c("content")), provider(first_string(c("content"), ("provider", "platform", "source")))))
    nested = F.coalesce(*(F.when(is_array(v), v) for v in (F.get_json_object("content", f"$.{k}") for k in ROOT_KEYS)))
    own_envelope = F.coalesce(F.upper(F.get_json_object("content", "$.format")).endswith(envelope), F.lit(False))
    all_ = F.when(is_array(c("content")), elements(c("content"))).when(is_object(c("content")) & ~own_envelope & nested.isNotNull(), elements(nested)).when(is_object(c("content")), F.array("content"))
    rows = files.select("name", hint.alias("hint"), own_envelope.alias("enveloped"), first.alias("first"), F.posexplode(all_).alias("place", "conversation")).withColumn("place", c("place") + c("first")).drop("first")
    return rows.where(is_object(c("conversation")))


def detected(conversation: Column, hint: Column) -> Column:
    """The provider of a conversation: what it says itself, else its shape, else the hint."""
    get = lambda path: F.get_json_object(conversation, path)
    first = F.coalesce(get("$.messages[0].role"), F.lit(""))
    return (
        F.when(first_string(conversation, ("provider", "platform", "source")).isNotNull(), provider(first_string(conversation, ("provider", "platform", "source")))).when(is_object(get("$.mapping")), "chatgpt")
        .when(is_array(get("$.chat_messages")), "claude").when(is_object(get("$.messages[0].message.author")) & get("$.messages[0].message.content").isNotNull(), "chatgpt")
        .when(F.lower(get("$.messages[0].sender")) == "human", "claude").when((F.lower(first) == "model") | is_array(get("$.messages[0].parts")), "gemini")
        .when(is_array(get("$.turns")), F.coalesce(hint, F.lit("gemini"))).otherwise(F.coalesce(hint, F.lit("generic")))
    )


def _in_time(message: Column, key: Column) -> Column:
    """What a mapping's messages are sorted by: their time in seconds (0 without), a time that is no number as it is written, their id, their key."""
    time = F.get_json_object(message, "$.create_time")
    seconds = F.coalesce(time.try_cast("double"), F.lit(0.0))
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(seconds.alias("seconds"), F.when(time.try_cast("double").isNull(), text(time)).otherwise("").alias("time"), text(F.get_json_object(message, "$.id")).alias("id"), key.alias("key"), message.alias("message"))


def normalised(files: DataFrame, envelope: str = "SOURCE_ENVELOPE") -> DataFrame:
    """One table of messages from files of any known shape: provider, conversation_id, title, sequence, role, text, message_id, created. Messages without text go before they are numbered; a mapping's messages come by their time."""
    c, get = F.col, lambda path: F.get_json_object("conversation", path)
    rows = conversations_of(files, envelope).withColumn("provider", detected(c("conversation"), c("hint")))
    listed = F.coalesce(*(F.when(is_array(get(f"$.{k}")), get(f"$.{k}")) for k in LIST_KEYS))
    listed = F.when((c("provider") == "claude") & is_array(get("$.chat_messages")), get("$.chat_messages")).otherwise(listed)
    nodes = F.transform(F.map_entries(F.from_json(get("$.mapping"), "map<string,string>")), lambda e: T.once(F.get_json_object(e["value"], "$.message"), lambda m: _in_time(m, e["key"])))
    nodes = F.transform(F.array_sort(nodes), lambda x: x["message"])
    rows = rows.select(
        "name", "provider", F.coalesce(first_string(c("conversation"), ("conversationExternalId", "conversation_id", "id", "uuid")), F.concat_ws("-", "name", "place")).alias("conversation_id"),
        F.coalesce(first_string(c("conversation"), ("conversationTitle", "title", "name")), F.lit("Conversation")).alias("title"), F.posexplode(F.when(is_object(get("$.mapping")), nodes).otherwise(elements(listed))).alias("at", "raw"),
    )
    message = F.when(is_object(F.get_json_object("raw", "$.message")), F.get_json_object("raw", "$.message")).otherwise(c("raw"))
    rows = rows.where("raw is not null").withColumn("message", message).withColumn("text", F.trim(extract_text("message"))).where(T.normalize_text(c("text")) != "")
    role = F.coalesce(first_string(c("message"), ROLE_KEYS), F.get_json_object("message", "$.author.role"), F.get_json_object("message", "$.author.name"), F.lit("unknown"))
    sequence = F.row_number().over(Window.partitionBy("name", "conversation_id").orderBy("at")) - 1
    rows = rows.withColumns({"sequence": sequence, "role": T.role(role)})
    ident = F.coalesce(first_string(c("message"), (*ID_KEYS, "externalId")), F.concat_ws("-", "conversation_id", "sequence"))
    return rows.select("provider", "conversation_id", "title", "sequence", "role", "text", ident.alias("message_id"), first_string(c("message"), TIME_KEYS).alias("created"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all exports under a path, files and archives of any size; that there are none is an error."""
    rows = normalised(read_files(spark, path))
    if rows.isEmpty():
        raise ValueError(f"{path}: no conversations of a known shape")
    return rows


def shard_rank(name: Column) -> Column:
    """Order of an export's shards: conversations.json, its numbered ones, chat.json, then others by name."""
    base = F.element_at(F.split(F.lower(name), "/"), -1)
    n = F.regexp_extract(base, r"^conversations-(\d+)\.json$", 1)
    return F.struct(F.when(base == "conversations.json", 0).when(n != "", 1).when(base == "chat.json", 2).otherwise(3).alias("rank"), F.when(n != "", n.try_cast("bigint")).otherwise(0).alias("n"), base.alias("base"))


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of runs (one JSON file each), newest first; broken ones and those without an output go."""
    schema = "runId string, completedAt string, outputPath string, inputBytes bigint, outputBytes bigint, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    kept = rows.where("_corrupt is null and outputPath is not null and outputPath <> ''").drop("_corrupt")
    return kept.orderBy(F.desc("completedAt"), "runId")
