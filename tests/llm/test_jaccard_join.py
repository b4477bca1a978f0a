import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillstone.llm import jaccard_join as J
from quillstone.llm.jaccard_join import jaccard_join, keep_one

from .brute import components


def corpus(seed, rows):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ÜBER", "Straße"]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice((3, 6, 40, 90, 200)))] for _ in range(30)]
    docs, n = [], 0
    hot = [rnd.choice(vocab) for _ in range(60)]
    for _ in range(rows):
        w = list(rnd.choice(base[:4] if rnd.random() < 0.5 else base))
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 5))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            w += hot
        docs.append((n, rnd.choice(" \t\n").join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
        n += rnd.randrange(1, 4)
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "x"), (n + 4, "X "), (n + 5, "long " * 30000)]


@pytest.mark.parametrize(("flush", "entries"), [(J.FLUSH, J.TASK_ENTRIES), (300, 500)])
def test_against_brute_force(spark, monkeypatch, flush, entries):
    monkeypatch.setattr(J, "FLUSH", flush)
    monkeypatch.setattr(J, "TASK_ENTRIES", entries)
    docs = corpus(5, 500)
    df = spark.createDataFrame([(a, b, "c", 1, 2) for a, b in docs], "doc_id long, text string, id string, n int, sig int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df).collect()}
    assert got == components(docs)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join(df).collect()), key=str) == [(1, 1, 1), (3, 1, 1), (3, 1, 1), (None, 1, None)]
    assert jaccard_join(df.limit(0)).count() == 0
    assert keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 300])
def test_nothing_shared(spark, rows):
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(3 + i % 40))) for i in range(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df).collect()} == components(docs)
    assert sorted(map(tuple, keep_one(df).collect())) == docs


def test_several_texts_of_one_id(spark):
    say = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = say("a"), say("b"), say("c")
    docs = [(1, a), (1, b), (7, b + " end"), (9, a + " end"), (4, c), (4, c), (4, "")]
    df = spark.createDataFrame([(*d, 5, 6, 7) for d in docs], "doc_id long, text string, t int, `__t` int, class int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect())
    assert got == [(1, 56, 1), (1, 56, 1), (4, 0, 4), (4, 56, 4), (4, 56, 4), (7, 57, 1), (9, 57, 1)]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (1, b), (4, ""), (4, c)]


def test_keep_one_against_brute_force(spark):
    docs = corpus(8, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = components(docs)
    assert sorted(keep_one(df).collect()) == sorted(spark.createDataFrame([d for d in docs if want[d[0]][1] == d[0]], df.schema).collect())


def test_frequent_columns_travel_as_two_entries():
    h = np.array([5, 5, 5, 5, 7, 9, 9], np.uint64)
    h, row, met = J._met_here(h, np.arange(7, dtype=np.uint64))
    assert h.tolist() == [5, 5, 7, 9, 9] and sorted(row.tolist() + met.tolist()) == list(range(7)) and len(met) == 2
