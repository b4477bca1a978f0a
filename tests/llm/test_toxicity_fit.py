import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillstone.llm import toxicity as T
from quillstone.llm import words as W
from quillstone.llm.labelled import distinct_texts
from quillstone.llm.store import Work

from .test_toxicity import corpus


@pytest.mark.parametrize("shard_rows", [None, 1300])
def test_every_labelled_row_is_learned(spark, monkeypatch, shard_rows):
    """A word that only rows have which a sample of 2500 of a label, by hash of the id, leaves out."""
    if shard_rows:
        monkeypatch.setattr(T, "SHARD_ROWS", shard_rows)
    order = [r.id for r in spark.range(3000).orderBy(F.xxhash64("id"), "id").collect()]
    rnd, plain = random.Random(5), [a + b + c for a in "klmnpr" for b in "aeiou" for c in ("st", "rn", "x", "nd")]
    say = lambda *more: " ".join(rnd.sample(plain, 8) + list(more))
    docs = [(i, say("grumbl" if at < 2500 else "vilest"), "en") for at, i in enumerate(order)] + [(3000 + i, say(), "en") for i in range(600)]
    labels = [(i, int(i < 3000)) for i, _, _ in docs]
    asked = [(10_000 + i, say("vilest" if i % 2 else "pinds"), "en") for i in range(40)]
    d = spark.createDataFrame(docs + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: r.toxic for r in T.verdicts(d, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False)).collect()}
    assert [got[i] for i, _, _ in asked] == [i % 2 == 1 for i, _, _ in asked]


def _tables(spark, n, seed):
    docs, labels = corpus(n, seed)
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, dict(labels)


def test_shards_are_averaged_as_plain_loops_do(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 60)
    monkeypatch.setattr(T, "ROUNDS", 2)  # more rounds grow what the last digits of a sum differ by
    d, lab, docs, labels = _tables(spark, 150, 4)
    texts = distinct_texts(d, lab, "toxic", F.lit(False), extra=("lang",))
    got = T.train(texts, 150, 1000, Work(spark, "test"))
    place = {r.digest: r.shard for r in texts.select("digest", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(3)).alias("shard")).collect()}
    rows = sorted((hashlib.sha256(t.encode()).hexdigest(), labels[i], t) for i, t, _ in docs)
    assert {x for x, _, _ in rows} == set(place) and set(place.values()) == {0, 1, 2}
    net = T.Network()
    for start in range(0, T.ROUNDS * T.PASSES, T.PASSES):
        nets, times, sizes = [], [], []
        for s in range(3):
            own = [r for r in rows if place[r[0]] == s]
            nets.append(net.copy())
            words = [T._ids(W.split(pa.array([t]), W.ALNUM, lower=True)).T for _, _, t in own]
            times.append(T.descend(nets[-1], words, np.array([y for _, y, _ in own]), range(start, start + T.PASSES), T.ROUNDS * T.PASSES, np.random.default_rng([7, start, s])))
            sizes.append(len(own))
        new = net.copy()
        for b in np.flatnonzero(sum(times)):
            share = [t[b] / sum(times)[b] for t in times]
            new.emb[b] += sum(w * (x.emb[b] - net.emb[b]) for w, x in zip(share, nets))
            new.grad2[b] += sum(w * (x.grad2[b] - net.grad2[b]) for w, x in zip(share, nets))
            new.touched[b] = True
        for k in ("filt", "bias", "out", "out_bias"):
            getattr(new, k)[...] = sum(n / sum(sizes) * getattr(x, k) for n, x in zip(sizes, nets))
        net = new
    want = net.model()
    assert np.allclose(got.table, want.table, atol=1e-3) and np.allclose(got.out, want.out, atol=1e-3) and np.allclose(got.bias, want.bias, atol=1e-3)


def test_partitions_and_order_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 60)
    d, lab, _, _ = _tables(spark, 200, 6)
    d = d.union(d.limit(30))
    one, cuts = T.fit(d, lab, F.lit(False))
    two, same = T.fit(d.repartition(5, "text").orderBy(F.desc("doc_id")), lab.repartition(3), F.lit(False))
    assert np.array_equal(one.table, two.table) and np.array_equal(one.out, two.out) and (one.shift, one.scale, cuts) == (two.shift, two.scale, same)


def test_calibration_counts_as_rows_do():
    rnd = np.random.default_rng(2)
    values, y = np.round(rnd.normal(size=400), 1), rnd.integers(0, 2, 400)
    langs = [("en", "fr", None)[i] for i in rnd.integers(0, 3, 400)]
    keys, counts = np.unique([f"{v}|{t}|{g}" for v, t, g in zip(values, y, langs)], return_counts=True)
    parts = [k.split("|") for k in keys]
    v, t, g = np.array([float(p[0]) for p in parts]), np.array([int(p[1]) for p in parts]), [p[2] if p[2] != "None" else None for p in parts]
    assert T.best_cut(v, t, counts) == T.best_cut(values, y)
    assert T._thresholds(v, t, g, counts) == T._thresholds(values, y, langs)
