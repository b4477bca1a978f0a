import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quillstone.llm import quality as Q
from quillstone.llm import words as W
from quillstone.llm.labelled import fold


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "klmnpr" for b in "aeiou" for c in ("st", "rn", "lé", "x", "nd")]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(4, 60))]
        kind = rnd.random()
        if kind < 0.2:
            w = [x.upper() + "!!" for x in w]
        elif kind < 0.4:
            w = [x for x in w[:3] for _ in range(12)]
        docs.append((i, " ".join(w)))
        labels += [(i, int(kind >= 0.4))] * rnd.choice((1, 2))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(500, 2)
    docs += [(1000, None), (1001, ""), (1002, "nope " * 50000), (None, "kast lorn"), (1003, "kast lorn mind")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = Q.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"), held)
    got = {r.doc_id: r.score for r in Q.score(d, model, ["doc_id"]).collect()}
    truth = dict(labels)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= Q.CUT) == bool(truth[i]) for i in out]) > 0.97
    assert len(got) == len(docs) and got[1000] == got[1001] and got[1002] < Q.CUT <= got[1003]
    assert Q.score(d.limit(0), model, ["doc_id"]).count() == 0


def test_lookup_equals_the_average():
    """Scoring by distinct words is the mean over all words and bigrams."""
    m = Q.Model(np.random.default_rng(1).normal(size=Q.BUCKETS).astype(np.float32), 0.25)
    texts = ["a a a bc", "", "Straße the the x", "z"]
    want = []
    for t in texts:
        w = t.split()
        buckets, n = Q.features([x.encode() for x in w])
        assert n.tolist() == [1 + sum(max(0, len(x.encode()) + 2 - k + 1) for k in Q.GRAMS) for x in w]
        runs = Q.bigrams(W.split(pa.array([t])))[1]
        assert len(runs) == max(0, len(w) - 1)
        own = [x.mean() for x in np.split(m.value[buckets], np.cumsum(n)[:-1])] if w else []
        want.append((sum(own) + m.value[runs].sum()) / max(1, len(w) + len(runs)) + 0.25)
    assert np.allclose(m.logits(W.split(pa.array(texts))), want, atol=1e-5)


def test_one_label():
    assert Q.train(["a"], np.array([1])).score(W.split(pa.array(["b", None]))).min() > Q.CUT
    assert Q.train([], np.array([], int)).score(W.split(pa.array(["b"]))).max() < Q.CUT
