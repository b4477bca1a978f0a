"""Snapshots of tables as JSON lines with a manifest, and their verified import; dates and hashes of records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import set_root

MANIFEST = "table string, n bigint, root string"


def canonical(table: DataFrame) -> Column:
    """A row as JSON with its columns by name; nulls are kept."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(table.columns))), {"ignoreNullFields": "false"})


def write_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table under its name, and the manifest: how many rows and the hash of the set of rows. Returns the manifest."""
    entries = []
    for name, table in sorted(tables.items()):
        lines = table.select(canonical(table).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/tables/{name}")
        entries.append(_entry(lines, name))
    manifest = next(iter(tables.values())).sparkSession.createDataFrame(entries, MANIFEST)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def _entry(lines: DataFrame, name: str) -> tuple:
    return name, lines.count(), set_root(lines.select(F.sha2(F.col("value").cast("binary"), 256).alias("h"))).first().root


def read_snapshot(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The asked tables of a snapshot. A table that isn't what the manifest says is an error that names it; one that the manifest lacks is empty."""
    manifest = {r["table"]: r for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()}  # a row a table
    out = {}
    for name, schema in schemas.items():
        if name not in manifest:
            out[name] = spark.createDataFrame([], schema)
            continue
        lines = spark.read.text(f"{path}/tables/{name}")
        if _entry(lines, name) != tuple(manifest[name]):
            raise ValueError(f"{path}: table {name} is not what its manifest says")
        out[name] = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return out


def parsed_date(c: Column) -> Column:
    """Epoch seconds or an ISO string as a timestamp; null of anything else. A string without a zone is in the session's."""
    seconds = c.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_millis(F.round(seconds * 1000).cast("bigint"))).otherwise(F.try_to_timestamp(c))


def _sorted_json(values: pd.Series) -> pd.Series:
    def one(v):
        try:
            return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return values.map(one)


def canonical_json(c: Column | str) -> Column:
    """JSON of any depth with sorted keys and no blanks; null of what isn't JSON."""
    return F.pandas_udf(_sorted_json, "string")(c)


def _fnv(values: pd.Series) -> pd.Series:
    def one(v):
        h = 0xCBF29CE484222325
        for b in v.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return values.map(lambda v: None if v is None else one(v))


def fnv1a64(c: Column | str) -> Column:
    """64-bit FNV-1a of a text's bytes, as hexadecimal digits; for parity with stored hashes alone (xxhash64 is Spark's own)."""
    return F.pandas_udf(_fnv, "string")(c)
