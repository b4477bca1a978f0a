"""Operator 10, toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the hashed vectors of the word and of its prefixes of `PREFIXES` bytes. Filters of several
widths run over the whole text, each is max-pooled, and a logistic layer reads the maxima. It is
trained on every labelled text, in rounds: texts are dealt by their digest to shards of bounded size, a task runs numpy stochastic gradient
descent over a shard from the network of the round before, and Spark averages what the shards changed, each bucket by how often a shard
changed it. The driver holds the network alone. Changes are summed as integers, so the order of tasks changes no score.
Scoring folds embeddings and filters into one table and runs in the tasks. Scores are
calibrated on all texts held back from training: 0.3 is the best cut over all of them, and each
language of which enough texts were held back has a threshold of its own for verdicts. The score itself never sees the language.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import distinct_texts, fold
from .store import Work, bounded_batches, fresh

#: Texts and bytes of text of a shard, about; a longer text is whole.
SHARD_ROWS, SHARD_BYTES = 4096, 32 << 20
#: Averages of several shards, and passes over a shard before each.
ROUNDS, PASSES = 3, 2
#: Of a hundred texts, those held back from training.
HELD = 15
BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Passes over a single shard, by its steps.
STEPS, EPOCHS = 20_000, (6, 40)
#: Share of a text's words that a training step leaves out.
DROP = 0.3
PREFIXES = (3, 5, 7)
RATE = 0.1
CUT = 0.3
#: Held-back texts of either label that a language needs for a threshold of its own.
LEAST_HELD = 10
#: Steps of a logit that calibration tells apart, and the largest it does.
BINS, MOST = 1024, 100
#: Unit of the changes that are summed.
FIXED = 1 << 30


def _ids(w: W.Words) -> np.ndarray:
    """Buckets of each word: of itself and of its prefixes."""
    mask = np.uint64(BUCKETS - 1)
    return np.stack([(h & mask).astype(np.int32) for h in (w.hash, *(w.prefix(n) for n in PREFIXES))], 1)


class Model:
    """table: what each bucket adds to each filter at each offset; bias, out, cut: the rest of the network and its calibration."""

    def __init__(self, table, bias, out, out_bias, scale, shift):
        self.table, self.bias, self.out, self.out_bias, self.scale, self.shift = table, bias, out, out_bias, scale, shift

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each text; 0 where none is positive. Words past a text's end count as nothing."""
        n = len(first) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        has = np.flatnonzero(np.diff(first) > 0)
        if not len(has):
            return out
        add = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            add += self.table[ids[:, k]]
        at, last = 0, np.repeat(first[1:], np.diff(first))
        for i, width in enumerate(WIDTHS):
            z = np.zeros((len(ids), FILTERS), np.float32)
            for j in range(width):
                part = add[j:, at : at + FILTERS]
                if j:
                    part = part * (np.arange(len(ids) - j) + j < last[: len(ids) - j])[:, None]
                z[: len(ids) - j] += part
                at += FILTERS
            out[has, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(z, first[:-1][has], axis=0)
        return np.maximum(out + self.bias, 0)

    def logit(self, ids, first) -> np.ndarray:
        return self.pooled(ids, first).astype(np.float64) @ self.out + self.out_bias

    def score(self, ids, first) -> np.ndarray:
        return self.calibrated(self.logit(ids, first))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((logit - self.shift) * self.scale + np.log(CUT / (1 - CUT)), -30, 30)))


class Network:
    """What is trained: a vector of each bucket, filters, their biases and the logistic layer; grad2 and touched: each bucket's squared gradients and whether a step met it."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.emb = rnd.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filt = np.concatenate([rnd.normal(0, 0.6, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS])
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.abs(rnd.normal(0, 0.3, len(self.bias))).astype(np.float32)
        self.out_bias = np.full(1, -1.0, np.float32)
        self.grad2 = np.full(BUCKETS, 1e-3, np.float32)
        self.touched = np.zeros(BUCKETS, bool)

    def dense(self) -> np.ndarray:
        """All but the buckets, as rows of `DIM` + 1 numbers."""
        flat = np.concatenate([self.filt.ravel(), self.bias, self.out, self.out_bias])
        return np.append(flat, np.zeros(-len(flat) % (DIM + 1), np.float32)).reshape(-1, DIM + 1)

    def changes(self, before: Network, times: np.ndarray, steps: int) -> pa.RecordBatch:
        """Of each changed bucket, and of the rest after them, the change since `before` times how often it was changed, and that number."""
        at = np.flatnonzero(times)
        rows = np.concatenate([self.emb[at] - before.emb[at], (self.grad2[at] - before.grad2[at])[:, None]], 1)
        rows = np.concatenate([rows, self.dense() - before.dense()]).astype(np.float64)
        ids = np.concatenate([at, BUCKETS + np.arange(len(rows) - len(at))]).astype(np.int32)
        times = np.concatenate([times[at], np.full(len(rows) - len(at), steps)]).astype(np.int64)
        fixed = np.rint(rows * FIXED).astype(np.int64) * times[:, None]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, times, *fixed.T)], _CHANGE)

    def move(self, ids: np.ndarray, times: np.ndarray, sums: np.ndarray) -> None:
        """Adds the mean of the shards' changes."""
        mean = (sums / times[:, None] / FIXED).astype(np.float32)
        own = ids < BUCKETS
        at = ids[own]
        self.emb[at] += mean[own, :DIM]
        self.grad2[at] += mean[own, DIM]
        self.touched[at] = True
        dense = self.dense()
        dense[ids[~own] - BUCKETS] += mean[~own]
        flat, sizes = dense.ravel(), np.cumsum([self.filt.size, len(self.bias), len(self.out), 1])
        filt, self.bias, self.out, self.out_bias = (x.copy() for x in np.split(flat, sizes)[:4])
        self.filt = filt.reshape(self.filt.shape)

    def copy(self) -> Network:
        other = object.__new__(Network)
        other.__dict__ = {k: v.copy() for k, v in self.__dict__.items()}
        return other

    def model(self) -> Model:
        emb = np.where(self.touched[:, None], self.emb, 0)  # words that no step has met say nothing
        return Model(np.concatenate([emb @ f for f in self.filt], 1), self.bias, self.out.astype(np.float64), float(self.out_bias[0]), 1.0, 0.0)


_SUMS = [f"v{i}" for i in range(DIM + 1)]
_CHANGE = ["id", "times", *_SUMS]


def descend(net: Network, docs: list[np.ndarray], y: np.ndarray, epochs: range, of: int, rnd: np.random.Generator) -> np.ndarray:
    """Steps over all texts (their words' buckets, as rows) in each of `epochs` of `of`; how often each bucket was changed."""
    times = np.zeros(BUCKETS, np.int64)
    emb, filt, bias, out, out_bias, grad2 = net.emb, net.filt, net.bias, net.out, net.out_bias, net.grad2
    for epoch in epochs:
        rate = RATE * (1 - epoch / of) + 0.01
        for d in rnd.permutation(len(docs)):
            ids = docs[d]
            n = ids.shape[1]
            if not n:
                continue
            x = emb[ids[0]]
            for row in ids[1:]:
                x += emb[row]
            x *= (rnd.random(n, np.float32) >= DROP)[:, None]
            parts = filt.transpose(0, 2, 1).reshape(-1, DIM) @ x.T  # of each filter and place in it, what each word gives
            best, where, at = [], [], 0
            for k in WIDTHS:
                z = parts[at : at + FILTERS]
                for j in range(1, min(k, n)):
                    z[:, : n - j] += parts[at + j * FILTERS : at + (j + 1) * FILTERS, j:]
                where.append(z.argmax(1))
                best.append(z[np.arange(FILTERS), where[-1]])
                at += k * FILTERS
            pool = np.concatenate(best) + bias
            act = np.maximum(pool, 0)
            g = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(act @ out + out_bias[0]))))) - float(y[d])
            if abs(g) < 1e-3:
                continue
            back = np.float32(g) * out * (pool > 0)
            out -= np.float32(rate) * (np.float32(g) * act + np.float32(1e-4) * out)
            out_bias -= np.float32(rate * g)
            bias -= np.float32(rate * 0.1) * back
            rows, deltas, at = [], [], 0
            for i, k in enumerate(WIDTHS):
                b = back[i * FILTERS : (i + 1) * FILTERS]
                for j in range(k):
                    f, to = filt[at + j], where[i] + j
                    ok = np.flatnonzero((to < n) & (b != 0))
                    if len(ok):
                        rows.append(ids[:, to[ok]].T)
                        deltas.append((f[:, ok] * b[ok]).T)
                        f[:, ok] -= np.float32(rate * 0.1) * x[to[ok]].T * b[ok]
                at += k
            if rows:
                rows, deltas = np.concatenate(rows), np.concatenate(deltas)
                deltas = np.repeat(deltas, rows.shape[1], 0)
                one, at = np.unique(rows.reshape(-1), return_inverse=True)
                total = np.zeros((len(one), DIM), np.float32)
                np.add.at(total, at, deltas)
                grad2[one] += (total**2).mean(1)
                emb[one] -= np.float32(0.3 * rate) / np.sqrt(grad2[one])[:, None] * total
                times[one] += 1
    return times


def _shards(net, epochs: range, of: int, seed: int):
    """For mapInArrow: the changes of each shard's texts, which come shard by shard, in order of their digests."""

    def run(batches):
        shard, docs, y = None, [], []
        for b in W.chunks(batches, "text"):
            w = W.split(b.column("text"), W.ALNUM, lower=True)
            ids = np.ascontiguousarray(_ids(w).T)
            for s, label, lo, hi in zip(b.column("shard").to_pylist(), b.column("label").to_pylist(), w.first[:-1], w.first[1:], strict=True):
                if s != shard and docs:
                    yield fitted(shard, docs, y)
                    docs, y = [], []
                shard = s
                docs.append(ids[:, lo:hi].copy())
                y.append(label)
        if docs:
            yield fitted(shard, docs, y)

    def fitted(shard, docs, y):
        own = net.value.copy()
        times = descend(own, docs, np.array(y), epochs, of, np.random.default_rng([seed, epochs.start, shard]))
        return own.changes(net.value, times, len(docs))

    return run


def train(texts: DataFrame, rows: int, size: int, work: Work, seed: int = 7) -> Model:
    """The network fitted to all of `texts` (digest, label, text), `rows` texts of `size` bytes; not yet calibrated."""
    shards = max(1, math.ceil(rows / SHARD_ROWS), math.ceil(size / SHARD_BYTES))
    passes, of = (PASSES, ROUNDS * PASSES) if shards > 1 else (min(EPOCHS[1], max(EPOCHS[0], STEPS // max(1, rows))),) * 2
    shard = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(shards)).cast("int")
    dealt = texts.select("digest", "label", "text", shard.alias("shard")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "digest")
    net, schema = Network(seed), ", ".join(["id int", "times long", *(f"{v} long" for v in _SUMS)])
    for start in range(0, of, passes):
        shared = texts.sparkSession.sparkContext.broadcast(net)
        changes = dealt.mapInArrow(_shards(shared, range(start, start + passes), of, seed), schema)
        sums = work.write(changes.groupBy("id").agg(*(F.sum(c).alias(c) for c in _CHANGE[1:])), "sums").toArrow()  # at most a row of each bucket
        net.move(*(sums.column(c).to_numpy() for c in _CHANGE[:2]), np.stack([sums.column(c).to_numpy() for c in _SUMS], 1))
        work.remove("sums")
        shared.unpersist()
    return net.model()


def best_cut(values: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> float | None:
    """The cut with the fewest errors, in the middle of its widest gap; None without both labels. A value stands for as many texts as `counts` says, else for one."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(values, kind="stable")
    v, t, n = values[order], y[order], np.ones(len(y), np.int64) if counts is None else counts[order]
    errors = np.concatenate([[0], np.cumsum((t == 1) * n)]) + np.concatenate([np.cumsum(((t == 0) * n)[::-1])[::-1], [0]])
    edge = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    gap = edge[1:] - edge[:-1]
    errors = np.where(gap > 0, errors, n.sum() + 1)
    least = np.flatnonzero(errors == errors.min())
    k = least[np.argmax(gap[least])]
    return float((edge[k] + edge[k + 1]) / 2)


def _thresholds(scores: np.ndarray, y: np.ndarray, langs: list, counts: np.ndarray | None = None) -> dict[str, float]:
    """Of each language with enough texts of either label, the best cut."""
    cuts, counts = {}, np.ones(len(y), np.int64) if counts is None else counts
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min(counts[own & (y == 1)].sum(), counts[own & (y == 0)].sum()) >= LEAST_HELD:
            cuts[lang] = min(0.9, max(0.1, best_cut(scores[own], y[own], counts[own])))
    return cuts


def _calibrate(model: Model, texts: DataFrame, work: Work) -> dict[str, float]:
    """Sets the model's shift and scale by all of `texts` (label, lang, text), which it counts by their logits; the thresholds of languages."""
    place = F.round(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("logit"))) * BINS).cast("int")
    found = score(texts, model, ["label", "lang"], out="logit", raw=True).select("lang", "label", place.alias("place"))
    found = work.write(found.groupBy("lang", "label", "place").agg(F.count("*").alias("n")), "held")
    bins = found.groupBy("place", "label").agg(F.sum("n").alias("n")).orderBy("place", "label").toPandas()  # at most two rows of each place
    logit, n = bins.place.to_numpy() / BINS, bins.n.to_numpy()
    cut = best_cut(logit, bins.label.to_numpy(), n)
    model.shift = 0.0 if cut is None else cut
    far = np.abs(logit - model.shift)
    order = np.argsort(far, kind="stable")
    spread = far[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)] if len(n) else 1.0
    model.scale = float(2.5 / max(spread, 1e-3))
    calibrated = Model(None, None, None, None, model.scale, model.shift).calibrated

    def cuts(key, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["place", "label"])
        got = _thresholds(calibrated(own.place.to_numpy() / BINS), own.label.to_numpy(), list(own.lang), own.n.to_numpy())
        return pd.DataFrame(got.items(), columns=["lang", "cut"])

    langs = found.where("lang is not null").groupBy("lang").applyInPandas(cuts, found.select("lang", F.lit(0.0).alias("cut")).schema)
    return dict(sorted((r.lang, r.cut) for r in langs.collect()))


def fit(docs: DataFrame, labels: DataFrame, unless, label: str = "toxic", lang_col: str = "lang", **columns) -> tuple[Model, dict[str, float]]:
    """(model, threshold of each language), from all labelled rows where `unless` is false. Fewer than two labels give a constant score."""
    work = Work(docs.sparkSession, "toxicity")
    texts = work.write(distinct_texts(docs, labels, label, unless, extra=(lang_col,), **columns).withColumnRenamed(lang_col, "lang"), "texts")
    held = F.pmod(F.xxhash64("digest"), F.lit(100)) < HELD
    of = texts.groupBy(held.alias("held"), "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    if len(found := {r.label for r in of}) < 2:
        n, level = len(WIDTHS) * FILTERS, float(max(found, default=0))
        model, cuts = Model(np.zeros((BUCKETS, sum(WIDTHS) * FILTERS), np.float32), np.zeros(n, np.float32), np.zeros(n), 0.0, 1.0, 3.0 - 6.0 * level), {}
    else:
        own = [r for r in of if not r.held]
        model = train(texts.where(~held), sum(r.n for r in own), sum(r["size"] for r in own), work)
        cuts = _calibrate(model, texts.where(held) if sum(r.held for r in of) == 2 else texts, work)
    work.drop()
    return model, cuts


def _scores(model, text: str, out: str, raw: bool):
    def run(batches):
        m: Model = model.value
        for b in W.chunks(batches, text, 1 << 19):
            w = W.split(b.column(0), W.ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array((m.logit if raw else m.score)(_ids(w), w.first))], [*b.schema.names[1:], out])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: str = "score", raw: bool = False) -> DataFrame:
    """`keep` columns and, as column `out`, the score of each whole text, 0 to 1 (or its logit, if `raw`); null and empty texts score what no word scores.

    Repeated rows are scored each; other columns are not read, and kept ones may have any names but `out`'s. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    text = fresh(docs.select(*keep), "text")[0]
    texts = docs.select(F.col(text_col).cast("string").alias(text), *(F.col(f"`{c}`") for c in keep))
    schema = texts.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias(out)).schema
    return texts.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), text, out, raw), schema)


def verdicts(docs: DataFrame, labels: DataFrame, unless, lang_col: str = "lang", id_col: str = "doc_id", **columns) -> DataFrame:
    """doc_id, score, threshold of the language (0.3 for others and null) and toxic (score >= threshold).

    Other columns are not read; repeated rows are scored each; without labels of both kinds nothing is
    learned and every text has one score. An empty table gives an empty result.
    """
    model, cuts = fit(docs, labels, unless, lang_col=lang_col, id_col=id_col, **columns)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(columns.get("text_col", "text")).alias("text"))
    threshold = _threshold(cuts, "lang")
    return score(own, model, ["doc_id", "lang"]).select(F.col("doc_id").alias(id_col), "score", threshold.alias("threshold"), (F.col("score") >= threshold).alias("toxic"))


def _threshold(cuts: dict[str, float], lang_col: str):
    out = F.lit(CUT)
    for lang, cut in cuts.items():
        out = F.when(F.col(lang_col) == lang, F.lit(cut)).otherwise(out)
    return out


def remove_toxic(docs: DataFrame, labels: DataFrame, unless, lang_col: str = "lang", **columns) -> DataFrame:
    """`docs` without the rows whose score reaches their language's threshold (0.3 where it has none), by one scan. All columns are kept as they are, whatever their names; repeated rows are judged each, an empty table stays empty."""
    model, cuts = fit(docs, labels, unless, lang_col=lang_col, **columns)
    own = fresh(docs, "score")[0]
    scored = score(docs, model, docs.columns, columns.get("text_col", "text"), own)
    return scored.where(F.col(own) < _threshold(cuts, lang_col)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_cnn_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted; beside them threshold and toxic, the verdict by the language's threshold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = verdicts(docs, labels, held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "toxic")
