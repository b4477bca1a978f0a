"""Operator 11, fill-in-the-middle transformation by DuckDB over Arrow batches.

Each task registers its batches with a DuckDB of its own and gets Arrow back; lines, cuts and joins are SQL.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .batches import extended

#: Marks before the prefix, the suffix and the middle: fixed values, as are seed and rates of `op11_...`.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CUT = f"""
with a as (select coalesce(i1, '') as text, regexp_extract_all(coalesce(i1, ''), '[^\\n]*\\n|[^\\n]+') as units, sha256($seed || ':' || coalesce(i0, '')) as h from batch),
b as (select *, len(units) as n, ('0x' || h[1:8])::bigint % (len(units) + 1) as c1, ('0x' || h[9:16])::bigint % (len(units) + 1) as c2, ('0x' || h[17:24])::bigint % 100 as h3, ('0x' || h[25:32])::bigint % 100 as h4 from a),
c as (select *, least(c1, c2) as x, greatest(c1, c2) as y, case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 >= $rate then 'plain' when h4 < $spm then 'spm' else 'psm' end as form from b),
d as (select *, array_to_string(list_slice(units, 1, x), '') as p, array_to_string(list_slice(units, x + 1, y), '') as m, array_to_string(list_slice(units, y + 1, n), '') as s from c)
select n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  case form when 'plain' then text when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end as output from d
"""
_BACK = f"""
select case i1 when 'psm' then split_part(split_part(i0, '{SUFFIX}', 1), '{PREFIX}', 2) || split_part(i0, '{MIDDLE}', 2) || split_part(split_part(i0, '{SUFFIX}', 2), '{MIDDLE}', 1)
  when 'spm' then split_part(split_part(i0, '{MIDDLE}', 1), '{PREFIX}', 2) || split_part(i0, '{MIDDLE}', 2) || split_part(split_part(i0, '{PREFIX}', 1), '{SUFFIX}', 2) else i0 end as restored from batch
"""


def _ask(sql: str, **values):
    """What asks a task's own DuckDB: one thread, rows in their order, nothing on disk (a batch has 2 MB of text, or one text)."""

    def start():
        db = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True, "temp_directory": ""})

        def run(batch: pa.RecordBatch):
            db.register("batch", pa.Table.from_batches([batch]))
            try:
                out = db.sql(sql, params=values).to_arrow_table()
            finally:
                db.unregister("batch")
            return [c.combine_chunks() for c in out.columns]

        return run

    return start


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Adds n (lines), form, prefix_chars, middle_chars and output: a text cut at two line ends and put together anew.

    Cuts and form come from a hash of seed and id, so any run gives the same; `rate` of 100 texts are transformed, of these `spm` with the suffix
    first. Null is read as empty; empty texts and those that have a mark stay plain, as they are. A null id hashes as no digits, repeated rows are
    alike; a column of a new one's name is replaced, others stay; an empty table stays empty.
    """
    fields = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    return extended(docs, {id_col: "string", text_col: "string"}, fields, _ask(_CUT, seed=str(seed), rate=rate, spm=spm))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds restored, the text before the transformation, from its output and form; outputs of another form (null too) are given back as they are."""
    return extended(rows.withColumn("restored", F.col(output_col)), {output_col: "string", form_col: "string"}, [StructField("restored", StringType())], _ask(_BACK))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed and restored; null and empty texts are plain, repeated rows come each, an empty table gives none, further columns are passed over."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = restore(fill_in_middle(docs).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP11_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
l as (select *, string_split(text, chr(10)) as raw from t),
u as (select * exclude (raw), list_concat(list_transform(raw[:-2], lambda x: x || chr(10)), list_filter(raw[-1:], lambda x: x <> '')) as unit from l),
c as (select *, len(unit) as n, ('0x' || substr(h, 1, 8))::bigint % (len(unit) + 1) as c1, ('0x' || substr(h, 9, 8))::bigint % (len(unit) + 1) as c2 from u),
f as (select *, least(c1, c2) as lo, greatest(c1, c2) as hi, case when text = '' or regexp_matches(text, '<[PSM]>') then 'plain' when ('0x' || substr(h, 25, 8))::bigint % 100 < 50 then 'spm' else 'psm' end as form from c),
p as (select *, list_aggregate(unit[1:lo], 'string_agg', '') as a, list_aggregate(unit[lo + 1:hi], 'string_agg', '') as b, list_aggregate(unit[hi + 1:], 'string_agg', '') as z from f),
q as (select *, coalesce(a, '') as pre, coalesce(b, '') as mid, coalesce(z, '') as suf from p)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from q
"""
