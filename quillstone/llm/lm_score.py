"""Operator 4, LM scoring: cross-entropy difference of matched n-gram models.

A target model (the documents of a given set) and a background model (all documents) are word bigram
models of one form: the same vocabulary (all distinct words of the corpus and one boundary mark), the
same Dirichlet smoothing towards add-one unigrams. A text w1..wn counts as the tokens w1..wn and a
boundary, each after its predecessor, the first after a boundary. A token's loss is -ln P in millionths
of a nat, rounded; a document's score is the mean over its tokens of target loss less background loss
(lower: more like the target).

Documents are dealt into chunks of bounded bytes. Each chunk counts its distinct words and bigrams and
sends them, packed, by ranges of their hash; a range adds up what all chunks sent and answers each with
the corpus's counts where they differ from the chunk's own, in the order sent (most bigrams are in one
chunk alone). A word or bigram travels once from a chunk however often it occurs there, so no key is
hot, and no table of counts is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Work, join_checked

CHUNK_BYTES = 8 << 20
LEAST_CHUNKS = 32
#: Weight of the unigram distribution, in occurrences.
PRIOR = 8.0
_BOUNDARY = np.uint64(0x243F6A8885A308D3)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hashes of each with its predecessor, the first token of each text and the end)"""
    w = W.split(texts, W.WHITE, lower=True)
    first = w.first + np.arange(len(w.first))
    tok = np.full(first[-1], _BOUNDARY, np.uint64)
    tok[np.arange(len(w.hash)) + w.doc()] = w.hash
    before = np.roll(tok, 1)  # the last token of all is a boundary
    with np.errstate(over="ignore"):
        return tok, W.mix(before * _LEFT + tok * _RIGHT), first


def _ranges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each of `shards` equal ranges of hashes begins in sorted keys, and the end."""
    edge = np.array([-(-(s << 64) // shards) for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edge), len(keys))


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys in little more than six bytes each: where their upper 16 bits rise and to what, then the lower 48 bits."""
    top = keys >> np.uint64(48)
    rise = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([len(rise).to_bytes(4, "little"), rise.astype("<u4").tobytes(), top[rise].astype("<u2").tobytes(), low.tobytes()])


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    rise, top = np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u2", n, 4 + 4 * n)
    low = np.frombuffer(data, np.uint8, offset=4 + 6 * n).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    out[:, 6:] = np.repeat(top, np.diff(np.append(rise, len(low)))).view(np.uint8).reshape(-1, 2)
    return out.view("<u8").ravel()


def _pack_counts(n: np.ndarray) -> bytes:
    """One byte for a count under 255; the others follow in full."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=size)
    return out


def _distinct(table) -> list[tuple[np.ndarray, ...]]:
    """Of the words and of the bigrams of a chunk: sorted keys, the key of each token, how often the chunk and its target documents have each."""
    *hashes, first = _tokens(table.column("__text"))
    flag = np.repeat(table.column("__target").to_numpy().astype(np.int64), np.diff(first))
    out = [first]
    for h in hashes:
        keys, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        out.append((keys, inverse, n.astype(np.int64), np.bincount(inverse, flag, len(keys)).astype(np.int64)))
    return out


def _counter(shards: int):
    def count(key, table):
        rows = []
        for kind, (keys, _, n, t) in enumerate(_distinct(table)[1:]):
            edge = _ranges(keys, shards)
            for s in np.flatnonzero(np.diff(edge)):
                cut = slice(edge[s], edge[s + 1])
                rows.append((kind * shards + int(s), key[0].as_py(), _pack(keys[cut]), _pack_counts(n[cut]), _pack_counts(t[cut])))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "chunk", "keys", "n", "t"])

    return count


def _add(table):
    """Of one range, for each chunk: a bit for each key it sent, set where the corpus has more of it, and the corpus's counts of those; n_keys, n_sum and t_sum of the range stand on one row."""
    keys = [_unpack(x) for x in table.column("keys").to_pylist()]
    own = [[_unpack_counts(x, len(k)) for x, k in zip(table.column(c).to_pylist(), keys, strict=True)] for c in ("n", "t")]
    one, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n, t = (np.bincount(inverse, np.concatenate(x), len(one)).astype(np.int64) for x in own)
    edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    parts = [inverse[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    more = [n[p] != x for p, x in zip(parts, own[0], strict=True)]
    parts = [p[m] for p, m in zip(parts, more, strict=True)]
    rest = [0] * (len(parts) - 1)
    packed = lambda xs: pa.array(list(xs), pa.binary())
    return pa.table({
        "shard": table.column("shard"), "chunk": table.column("chunk"), "more": packed(np.packbits(m).tobytes() for m in more), "n": packed(_pack_counts(n[p]) for p in parts), "t": packed(_pack_counts(t[p]) for p in parts),
        "n_keys": pa.array([len(one), *rest], pa.int64()), "n_sum": pa.array([int(n.sum()), *rest], pa.int64()), "t_sum": pa.array([int(t.sum()), *rest], pa.int64()),
    })


def _loss(pair, word, before, total: int, vocabulary: int) -> np.ndarray:
    base = (word + 1.0) / (total + vocabulary)
    return np.rint(-np.log((pair + PRIOR * base) / (before + PRIOR)) * 1e6).astype(np.int64)


def _scorer(shards: int, vocabulary: int, n_all: int, n_target: int):
    def run(docs, counts):
        first, *kinds = _distinct(docs)
        answer = {r["shard"]: r for r in counts.to_pylist()}
        for kind, (keys, _, n, t) in enumerate(kinds):
            edge = _ranges(keys, shards)
            for s in np.flatnonzero(np.diff(edge)):
                r = answer[kind * shards + int(s)]
                at = edge[s] + np.flatnonzero(np.unpackbits(np.frombuffer(r["more"], np.uint8), count=int(edge[s + 1] - edge[s])))
                n[at], t[at] = (_unpack_counts(r[c], len(at)) for c in ("n", "t"))
        sums = []
        for c, total in ((3, n_target), (2, n_all)):
            word, pair = (k[c][k[1]].astype(np.float64) for k in kinds)
            loss = _loss(pair, word, np.roll(word, 1), total, vocabulary)
            sums.append(np.add.reduceat(loss, first[:-1]) if len(loss) else np.zeros(0, np.int64))
        n = np.diff(first)
        return docs.select([c for c in docs.column_names if c not in ("__text", "__chunk", "__target")]).append_column("n_tokens", pa.array(n)).append_column("target_unats", pa.array(sums[0])).append_column("background_unats", pa.array(sums[1])).append_column("score", pa.array((sums[0] - sums[1]) / n / 1e6))

    return run


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_tokens (words and the boundary), target_unats and background_unats
    (summed losses, millionths of a nat) and score (nats per token).

    targets holds the ids of the target set, any number of times; ids that docs doesn't have say nothing.
    Null and empty texts are one boundary token; a null id is never in the target; repeated rows count and
    score each; with an empty target set the target model is uniform. An empty table gives an empty result.
    Other columns are not read.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "lm")
    chosen = work.write(targets.select(F.col(id_col).alias("__id")).where("__id is not null").distinct(), "targets")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-size // CHUNK_BYTES))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("__id"))
    rows = join_checked(rows, chosen.withColumn("__target", F.lit(True)), "__id", "left", 16 * chosen.count()).drop("__id")
    place = F.pmod(F.xxhash64(id_col, F.octet_length("__text")), F.lit(chunks)).cast("int")
    rows = rows.withColumns({"__target": F.coalesce("__target", F.lit(False)), "__chunk": place})
    sent = rows.groupBy("__chunk").applyInArrow(_counter(chunks), "shard int, chunk int, keys binary, n binary, t binary")
    counts = work.write(sent.groupBy("shard").applyInArrow(_add, "shard int, chunk int, more binary, n binary, t binary, n_keys long, n_sum long, t_sum long"), "counts")
    total = counts.where(F.col("shard") < chunks).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "n_sum", "t_sum"))).first()
    kind = dict(docs.dtypes)[id_col]
    both = rows.groupBy("__chunk").cogroup(counts.select("shard", F.col("chunk").alias("__chunk"), "more", "n", "t").groupBy("__chunk"))
    return both.applyInArrow(_scorer(chunks, *total), f"`{id_col}` {kind}, n_tokens long, target_unats long, background_unats long, score double")


def op4_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    """All documents, with those that labels mark as of quality 1 for the target."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels.where("quality = 1").select("doc_id"))


OP4_SQL = r"""
with d as (
  select doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') as ws,
    doc_id in (select doc_id from labels where quality = 1) as tgt
  from documents
), tok as (
  select doc_id, tgt, unnest(ws) as w, unnest(list_prepend('', ws[1:len(ws) - 1])) as h from d
), uni as (select w, count(*) as n, count(*) filter (tgt) as t from tok group by w
), bi as (select h, w, count(*) as n, count(*) filter (tgt) as t from tok group by h, w
), tot as (select count(*) as v, sum(n) as n, sum(t) as t from uni
), loss as (
  select tok.doc_id,
    cast(round(-ln((bi.t + 8.0::double * ((u.t + 1.0::double) / (tot.t + tot.v)::double)) / (p.t + 8.0::double)) * 1e6::double) as bigint) as lt,
    cast(round(-ln((bi.n + 8.0::double * ((u.n + 1.0::double) / (tot.n + tot.v)::double)) / (p.n + 8.0::double)) * 1e6::double) as bigint) as ln
  from tok join bi on bi.h = tok.h and bi.w = tok.w join uni u on u.w = tok.w join uni p on p.w = tok.h cross join tot
)
select doc_id, count(*) as n_tokens, cast(sum(lt) as bigint) as target_unats, cast(sum(ln) as bigint) as background_unats,
  (cast(sum(lt) as bigint) - cast(sum(ln) as bigint))::double / count(*)::double / 1e6::double as score
from loss group by doc_id
"""
