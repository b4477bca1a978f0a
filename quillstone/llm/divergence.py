"""Operator 13, divergence of sources by a split into heavy and light terms.

Counts of terms by language and source come from Arrow batches, summed within a batch, within a task and by shuffle.
A term has a share p in every group of its language, b where it doesn't occur. For two groups, the sum of
f(p, q) = (p - q)^2 / (p + q), rounded down for each term, is V f(b, b') and what terms that occur add to that:
terms that many groups have are laid out as dense tiles of groups by terms; of rarer ones, those of one group are counted by
p, and pairs within a term's short posting list are corrected. All sums are of 64-bit integers, so they add up exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Work, join_checked

#: A term is heavy if more than one in so many groups of its language has it; terms of a tile and groups of a tile's side, about.
HEAVY_SHARE, TILE_TERMS, TILE_GROUPS = 4, 512, 256
#: Bytes of a group's row, for the choice of joins, and partial sums of posting pairs held at once.
GROUP_BYTES, HELD_PAIRS = 256, 1 << 21
SCALE = 1_000_000_000

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _count(batches):
    """(lang, source, term, n, df) of each run of rows; a group's row without a term says that the group occurs."""
    for b in W.chunks(batches, "text"):
        w = W.split(b.column(2), LETTERS, lower=True, hashes=False)
        ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
        own = np.ascontiguousarray(w.data[LETTERS[w.data]])  # words, one behind the other
        terms = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(ends), pa.py_buffer(own)).dictionary_encode()
        code, k = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(terms.dictionary), 1)
        lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        pair = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
        groups, first, of = np.unique(pair, return_index=True, return_inverse=True)
        each, tf = np.unique(w.doc() * k + code, return_counts=True)
        keys, inverse = np.unique(of[each // k] * k + each % k, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, inverse, tf)
        df = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
        at = pa.array(np.concatenate([first[keys // k], first]))
        term = pa.concat_arrays([terms.dictionary.take(pa.array(keys % k)), pa.nulls(len(groups), pa.large_string())]).cast(pa.string())
        zeros = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), term, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([df, zeros]))], ["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term of a group, and a row with a null term for each group. Nulls are read as ''."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    return own.mapInArrow(_count, "lang string, source string, term string, n bigint, df bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)) as a bigint, by decimals; 0 where no term is kept."""
    wide = lambda c, size: c.cast(f"decimal({size},0)")
    made = F.call_function("div", wide(F.lit(SCALE), 10) * wide(n + 2, 19), wide(F.greatest(total + 2 * v, F.lit(1)), 20))
    return F.when(v > 0, 1 + made.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), F.greatest(p + q, F.lit(1).cast("bigint")))


def _f(p, q):
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _frame(lang, g, h, v) -> pd.DataFrame:
    return pd.DataFrame({"lang": np.full(len(v), lang, object), "g": g, "h": h, "v": v})


def _grid(lang, g, h, v) -> pd.DataFrame:
    """Entries of a matrix of groups by groups whose row's group is the smaller one."""
    keep = g[:, None] < h[None, :]
    return _frame(lang, np.broadcast_to(g[:, None], keep.shape)[keep], np.broadcast_to(h[None, :], keep.shape)[keep], v[keep])


def _sides(key, rows: pd.DataFrame):
    """The two blocks of a tile: groups, ascending, and their b."""
    base = rows[rows.kind == 0].sort_values("g")
    for block in key[1:3]:
        own = base[base.block == block]
        yield block, own.g.to_numpy(np.int64), own.b.to_numpy(np.int64)


def _dense(key, rows: pd.DataFrame) -> pd.DataFrame:
    """What heavy terms of a tile add to the sums of its pairs of groups."""
    cells = rows[rows.kind == 1]
    code, known = pd.factorize(cells.term)
    made = []
    for block, g, b in _sides(key, rows):
        own = (cells.block == block).to_numpy()
        m = np.repeat(b[:, None], len(known), axis=1)
        m[np.searchsorted(g, cells.g.to_numpy(np.int64)[own]), code[own]] = cells.p.to_numpy(np.int64)[own]
        made.append((g, b, m))
    (g, b, m), (h, c, k) = made
    v = np.stack([_f(x, k).sum(axis=1) for x in m]) if len(g) else np.zeros((0, len(h)), np.int64)
    return _grid(key[0], g, h, v - len(known) * _f(b[:, None], c[None, :]))


def _single(key, rows: pd.DataFrame) -> pd.DataFrame:
    """V f(b, b') for all pairs of a tile's groups, and what light terms add where only one of the two has them: `v` terms of share p."""
    total = int(rows.v[rows.kind == 0].max())
    (i, g, b), (j, h, c) = _sides(key, rows)
    v = total * _f(b[:, None], c[None, :])
    for block, here, own, other, sign in ((i, g, b, c, False), (j, h, c, b, True)):
        part = rows[(rows.kind == 1) & (rows.block == block)]
        at, p, many = np.searchsorted(here, part.g.to_numpy(np.int64)), part.p.to_numpy(np.int64), part.v.to_numpy(np.int64)
        add = np.zeros((len(own), len(other)), np.int64)
        for a in range(0, len(p), 4096):
            s = slice(a, a + 4096)
            np.add.at(add, at[s], many[s, None] * (_f(p[s, None], other[None, :]) - _f(own[at[s], None], other[None, :])))
        v = v + (add.T if sign else add)
    return _grid(key[0], g, h, v)


def _summed(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, v)
    return keys, out


def _pairs(key, rows: pd.DataFrame) -> pd.DataFrame:
    """What pairs within the posting lists of light terms add beyond their single entries."""
    rows = rows.sort_values(["term", "g"])
    term = pd.factorize(rows.term)[0]
    g, p, b = (rows[c].to_numpy(np.int64) for c in ("g", "p", "b"))
    keys, sums, held, d = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 1
    while d < len(g) and len(at := np.flatnonzero(term[:-d] == term[d:])):  # entries that are d apart in one list
        x, y = at, at + d
        held.append((g[x] << 32 | g[y], _f(p[x], p[y]) - _f(p[x], b[y]) - _f(b[x], p[y]) + _f(b[x], b[y])))
        if sum(len(k) for k, _ in held) > HELD_PAIRS:
            keys, sums = _summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([sums, *(s for _, s in held)]))
            held = []
        d += 1
    keys, sums = _summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([sums, *(s for _, s in held)]))
    return _frame(key[0], keys >> 32, keys & 0xFFFFFFFF, sums)


def _meet(rows: DataFrame) -> DataFrame:
    """Rows of a block at every tile of two blocks, the smaller one first, that has it."""
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    met = rows.select("*", other)
    return met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): of each group, the other sources of its language by their distance (part `pair`), and the `top` terms that it has more of than its language (`term`).

    Terms are those in at least `least_docs` documents (rows) of a language. Null languages, sources and texts are '', a group of their own; a
    language without kept terms has pairs of value 0; repeated rows count each; of equal values the smaller item comes first; an empty
    table gives no rows; further columns are passed over.
    """
    work = Work(docs.sparkSession, "divergence")
    counts = work.write(term_counts(docs, lang, source, text), "counts")
    w = Window.partitionBy("lang", "term").orderBy("source")  # a term's groups: no more than sources
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = counts.where("term is not null").withColumns({"docs": F.sum("df").over(whole), "all_n": F.sum("n").over(whole), "k": F.count("*").over(whole), "head": (F.row_number().over(w) == 1).cast("bigint")})
    kept = work.write(kept.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "k", "head"), "kept")
    per_lang = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    of_lang = Window.partitionBy("lang")  # a language's sources
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0)
    groups = groups.withColumns({"g": (F.row_number().over(of_lang.orderBy("source")) - 1).cast("bigint"), "groups": F.count("*").over(of_lang)})
    groups = groups.withColumns({"b": share(F.lit(0).cast("bigint"), F.col("group_n"), F.col("terms")), "block": F.floor(F.col("g") / TILE_GROUPS), "blocks": F.ceil(F.col("groups") / TILE_GROUPS), "tiles": F.ceil(F.col("terms") / TILE_TERMS)})
    groups = work.write(groups, "groups")
    work.remove("counts")
    size = groups.count() * GROUP_BYTES

    cells = join_checked(kept, groups, ["lang", "source"], "inner", size).withColumns({"p": share(F.col("n"), F.col("group_n"), F.col("terms")), "tile": F.pmod(F.xxhash64("term"), F.greatest("tiles", F.lit(1)))})
    heavy = F.col("k") * HEAVY_SHARE > F.col("groups")
    kind = lambda i: F.lit(i).alias("kind")
    shape = "lang string, g bigint, h bigint, v bigint"
    no = F.lit(None)
    sides = groups.select("lang", "block", "blocks", kind(0), "g", "b", no.cast("bigint").alias("p"), F.col("terms").alias("v"), no.cast("string").alias("term"), "tiles")
    laid = cells.where(heavy).select("lang", "block", "blocks", kind(1), "g", "b", "p", no.cast("bigint").alias("v"), "term", "tile")
    tiled = sides.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile")).where("tiles > 0").drop("tiles")
    dense = _meet(laid.unionByName(tiled)).groupBy("lang", "i", "j", "tile").applyInPandas(_dense, shape)
    alone = cells.where(~heavy).groupBy("lang", "block", "blocks", "g", "b", "p").agg(F.count("*").alias("v")).withColumns({"kind": F.lit(1), "term": no.cast("string")})
    single = _meet(sides.drop("tiles").unionByName(alone)).groupBy("lang", "i", "j").applyInPandas(_single, shape)
    light = cells.where(~heavy & (F.col("k") > 1)).select("lang", "tile", "term", "g", "p", "b")
    pairs = light.groupBy("lang", "tile").applyInPandas(_pairs, shape)

    total = dense.unionByName(single).unionByName(pairs).groupBy("lang", "g", "h").agg(F.sum("v").alias("value"))
    both = total.select("lang", F.inline(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))), "value")
    name = lambda own, new: groups.select("lang", F.col("g").alias(own), F.col("source").alias(new))
    named = join_checked(join_checked(both, name("g", "source"), ["lang", "g"], "inner", size), name("h", "item"), ["lang", "h"], "inner", size)
    q = share(F.col("all_n"), F.col("lang_n"), F.col("terms"))
    terms = cells.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return out(named, "pair").unionByName(out(terms, "term").where(F.col("rank") <= top))


def op13_heavy_light_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of `documents`, terms in at least 10 documents of a language, the ten foremost terms of a group; for nulls, empty texts, ties, repeated rows, empty tables and further columns see `divergence`."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
x as (select r, lang, source, unnest(w) as t from d), kept as (select lang, t from (select distinct r, lang, t from x) group by all having count(*) >= 10),
v as (select lang, (select count(*) from kept k where k.lang = l.lang)::hugeint as v from (select distinct lang from d) l), c as (select lang, source, t, count(*)::hugeint as n from x semi join kept using (lang, t) group by all),
g as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join c using (lang, source) group by all),
p as (select lang, source, t, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v) as p from g join kept using (lang) join v using (lang) left join c using (lang, source, t)),
q as (select lang, t, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v) as q from (select *, (sum(n) over (partition by lang))::hugeint as total from (select lang, t, sum(n)::hugeint as n from c group by all)) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs z on z.lang = a.lang and z.source = a.source and z.item = b.source),
term as (select lang, source, 'term' as part, t as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, t) where n > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term) qualify part = 'pair' or rank <= 10
"""
