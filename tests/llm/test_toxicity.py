import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quillstone.llm import toxicity as T
from quillstone.llm import words as W
from quillstone.llm.labelled import fold


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "klmnpr" for b in "aeiou" for c in ("st", "rn", "lé", "x", "nd")]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        bad = int(rnd.random() < 0.3)
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["grumbl", "Grumbly,", "snark!", "vileté"]))
        docs.append((i, " ".join(w), rnd.choice(["en", "fr", None])))
        labels += [(i, bad)] * rnd.choice((1, 1, 2))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(600, 1)
    docs += [(1000, None, "en"), (1001, "", None), (1002, "grumbl", "de"), (None, "a snark", "en"), (1003, "kast " * 40000, "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    got = {r.doc_id: r for r in T.verdicts(d, lab, held).collect()}
    truth = dict(labels)
    import zlib

    out = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i].score >= T.CUT) == truth[i] for i in out]) > 0.97
    assert np.mean([got[i].toxic == bool(truth[i]) for i in out]) > 0.97
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert not got[1000].toxic and not got[1001].toxic and got[1002].toxic and not got[1003].toxic


def test_pooling_against_plain_loops():
    rnd = np.random.default_rng(0)
    table = rnd.normal(size=(T.BUCKETS, sum(T.WIDTHS) * T.FILTERS)).astype(np.float32)
    m = T.Model(table, np.zeros(len(T.WIDTHS) * T.FILTERS, np.float32), np.ones(len(T.WIDTHS) * T.FILTERS), 0.0, 1.0, 0.0)
    w = W.split(pa.array(["a b c d", "", "x", None, "p q"]), W.ALNUM, lower=True)
    ids, got = T._ids(w), m.pooled(T._ids(w), w.first)
    for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        col = 0
        for i, k in enumerate(T.WIDTHS):
            best = np.zeros(T.FILTERS)
            for p in range(a, b):
                z = sum(table[ids[p + j], col + j * T.FILTERS : col + (j + 1) * T.FILTERS].sum(0) for j in range(k) if p + j < b)
                best = np.maximum(best, z)
            assert np.allclose(got[d, i * T.FILTERS : (i + 1) * T.FILTERS], best, atol=1e-4)
            col += k * T.FILTERS


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in T.verdicts(d, lab, F.lit(False)).collect()] == [False]
    assert T.verdicts(d.limit(0), lab, F.lit(False)).count() == 0


def test_odd_columns_and_repeated_rows(spark):
    docs, labels = corpus(300, 3)
    rows = [(i, t, l, 0.5, "x", {"k": i}) for i, t, l in docs for _ in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, `__text` string, `_score` map<string,long>")
    left = T.remove_toxic(d, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False))
    assert left.columns == d.columns
    got = sorted((r.doc_id, r.score, r["__text"], r["_score"]["k"]) for r in left.collect())
    bad = {i for i, y in labels if y}
    assert got == sorted((r[0], 0.5, "x", r[0]) for r in rows if r[0] not in bad)


def test_thresholds_of_languages():
    scores, y = np.array([0.2] * 12 + [0.6] * 12 + [0.1, 0.9]), np.array([0] * 12 + [1] * 12 + [0, 1])
    cuts = T._thresholds(scores, y, ["en"] * 24 + ["fr"] * 2)
    assert cuts == {"en": 0.4}
