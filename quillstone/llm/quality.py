"""Operator 3, quality classifier: supervised subword embeddings.

Words (runs without white space), their byte n-grams of `GRAMS` lengths, with word ends marked, and all word
bigrams are hashed to vectors. A word's own vector is the mean of its and its n-grams'; a document is the average of the vectors of all
its words and bigrams, and a softmax over two labels reads it. A bigram is hashed by the exclusive or of its words' hashes, in any order. Vectors and output are learned together by numpy stochastic gradient descent
on the driver, from a bounded sample of labelled rows (`ROWS_EACH` of either label). As the output is
linear in the average, each bucket is one number when scoring, and each distinct word is looked up once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import fold, sample
from .store import bounded_batches, fresh
from .toxicity import best_cut

ROWS_EACH = 1200
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
STEPS, EPOCHS = 20_000, (6, 30)
CUT = 0.3
RATE, EMB_RATE = 0.5, 2.0
CACHE_WORDS = 1 << 19


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word and of its n-grams, in turn; how many each word has)"""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    end = np.cumsum(sizes)
    last = np.repeat(end, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15)
        for n in GRAMS:
            m = max(0, len(data) - n + 1)
            h = np.zeros(m, np.uint64)
            for j in range(n):
                h = h * power + data[j : j + m] + np.uint64(1)
            at = np.flatnonzero(np.arange(len(h)) + n <= last[: len(h)])
            hashes.append(W.mix(h[at] + np.uint64(n)))
            owners.append(owner[at])
        whole = pd.util.hash_array(np.array([w.decode("utf-8", "replace") for w in words], object), categorize=False) if words else np.zeros(0, np.uint64)
        hashes.append(W.mix(whole.astype(np.uint64)))
        owners.append(np.arange(len(words)))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return (h[order] & np.uint64(BUCKETS - 1)).astype(np.int32), np.bincount(o, minlength=len(words))


class Model:
    """value: of each bucket, its vector along the output's difference; bias, scale and shift: the output's and the calibration's."""

    def __init__(self, value, bias=0.0, scale=1.0, shift=0.0):
        self.value, self.bias, self.scale, self.shift = value, bias, scale, shift
        self.known, self.sums = np.zeros(0, np.uint64), np.zeros(0)

    def logits(self, w: W.Words) -> np.ndarray:
        which, keys = pd.factorize(w.hash)
        one = np.zeros(len(keys), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.known) > CACHE_WORDS:
            self.known, self.sums = self.known[:0], self.sums[:0]
        new = np.flatnonzero(~np.isin(keys, self.known, assume_unique=True))
        if len(new):
            buckets, n = features([w.raw(i) for i in one[new]])
            edge = np.concatenate([[0], np.cumsum(n)])
            total = np.concatenate([[0.0], np.cumsum(self.value[buckets].astype(np.float64))])
            order = np.argsort(keys[new])
            to = np.searchsorted(self.known, keys[new][order])
            self.known = np.insert(self.known, to, keys[new][order])
            self.sums = np.insert(self.sums, to, ((total[edge[1:]] - total[edge[:-1]]) / n)[order])
        place = np.searchsorted(self.known, keys)[which]
        at, buckets = bigrams(w)
        sums, counts = self.sums[place], np.ones(len(place), np.int64)
        sums[at] += self.value[buckets]
        counts[at] += 1
        sums = np.diff(np.concatenate([[0.0], np.cumsum(sums)])[w.first])
        return sums / np.maximum(np.diff(np.concatenate([[0], np.cumsum(counts)])[w.first]), 1) + self.bias

    def score(self, w: W.Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.logits(w) - self.shift) * self.scale + np.log(CUT / (1 - CUT)), -30, 30)))


def bigrams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words that another of their text follows, and the bucket of each such pair, in its order."""
    at = np.flatnonzero(np.arange(1, len(w.hash) + 1) < np.repeat(w.first[1:], w.count))
    with np.errstate(over="ignore"):
        pair = w.hash[at] * W.ODD + w.hash[at + 1]
    return at, (W.mix(pair) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets of a text, the share of each)"""
    w = W.split(pa.array([text]))
    which, keys = pd.factorize(w.hash)
    one = np.zeros(len(keys), np.int64)
    one[which[::-1]] = np.arange(len(which))[::-1]
    buckets, n = features([w.raw(i) for i in one])
    each = np.bincount(which, minlength=len(keys)) / n
    weight = np.bincount(buckets, np.repeat(each, n), BUCKETS) + np.bincount(bigrams(w)[1], minlength=BUCKETS)
    ids = np.flatnonzero(weight)
    return ids, (weight[ids] / max(weight.sum(), 1)).astype(np.float32)


def train(texts: list[str], y: np.ndarray, seed: int = 11) -> Model:
    """Fits vectors and softmax to whole texts; 15 % are kept back for the calibration. Without both labels the score is constant."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), shift=3.0 - 6.0 * float(y[0]) if len(y) else 3.0)
    rnd = np.random.default_rng(seed)
    emb = rnd.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    bags = [_bag(t) for t in texts]
    held = rnd.random(len(bags)) < 0.15
    steps = np.flatnonzero(~held)
    seen = np.zeros(BUCKETS, bool)
    epochs = min(EPOCHS[1], max(EPOCHS[0], STEPS // max(1, len(steps))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.01
        for d in rnd.permutation(steps):
            ids, share = bags[d]
            if not len(ids):
                continue
            x = share @ emb[ids]
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = p @ out
            out -= rate * np.outer(p, x)
            bias -= rate * 0.1 * p
            emb[ids] -= rate * EMB_RATE * share[:, None] * back
            seen[ids] = True
    emb[~seen] = emb[seen].mean(0) if seen.any() else 0  # what training has not met says what the average does
    model = Model((emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))
    own = np.flatnonzero(held) if held.any() and 0 < y[held].mean() < 1 else np.arange(len(bags))
    logit = np.array([float(model.value[bags[d][0]] @ bags[d][1]) + model.bias for d in own])
    cut = best_cut(logit, y[own])
    model.shift = 0.0 if cut is None else cut
    model.scale = float(2.5 / max(np.median(np.abs(logit - model.shift)), 1e-3))
    return model


def fit(docs: DataFrame, labels: DataFrame, unless, label: str = "quality", rows_each: int = ROWS_EACH, **columns) -> Model:
    """From labelled rows where `unless` is false. Null labels, ids and texts are passed over, repeated texts count once; without rows of both labels the score is constant."""
    rows = sample(docs, labels, label, rows_each, unless, **columns)
    return train([r.text for r in rows], np.array([r.label for r in rows], np.int64))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns and the score of each whole text, 0 to 1 (higher: label 1 likelier); a text without words, null or empty, scores by the bias alone.

    Repeated rows are scored each; other columns are not read, and kept ones may have any names but score. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    text = fresh(docs.select(*keep), "text")[0]
    texts = docs.select(F.col(text_col).cast("string").alias(text), *(F.col(f"`{c}`") for c in keep))
    schema = texts.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for b in W.chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(m.score(W.split(b.column(0))))], [*b.schema.names[1:], "score"])

    return texts.mapInArrow(scan, schema)


def op3_subword_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = score(docs, fit(docs, labels, held), ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
