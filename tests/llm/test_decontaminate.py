import random

import quillstone.llm.decontaminate as D
from pyspark.sql import functions as F

from . import brute


def tables(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(25)] + ["Été", "a-b", "x_y"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice((1, 2, 5, 10, 11, 25)))) for i in range(12)] + [(50, None), (51, "--"), (3, say(12))]
    docs = []
    for i in range(60):
        t = say(rnd.choice((0, 3, 40)))
        for _ in range(rnd.randrange(3)):
            w = (rnd.choice(items)[1] or "").split(" ")
            a = rnd.randrange(len(w))
            t += rnd.choice((" ", ", ", "\n")) + " ".join(w[a:]).lower() + " " + say(3)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, items[-1][1]), (103, items[-1][1]), (104, "z " * 30000 + items[-1][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_spans_and_items(spark, monkeypatch):
    docs, items, d, b = tables(spark, 1)
    want = brute.contaminated(docs, items)
    for most in (D.BLOCK_BYTES, 60):
        monkeypatch.setattr(D, "BLOCK_BYTES", most)
        got = {r.doc_id: (r.n_words, sum(x.end - x.start for x in r.spans), sorted(r.items)) for r in D.contamination(d, b).collect()}
        assert got == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 32 << 20)
    left = {r.doc_id for r in D.decontaminate(d.withColumn("spans", F.lit(1)), b).collect()}
    assert left == {k for k, v in want.items() if not v[1]}


def test_longest(spark):
    docs, items, d, b = tables(spark, 2)
    docs, items = docs[:-1], items[:12]
    got = {(r.item_id, r.item_word): r.length for r in D.longest_matches(d.where("doc_id < 104"), b.where("item_id < 50").limit(12)).collect()}
    want = brute.longest(docs, items)
    assert got == want and want


def test_empty(spark):
    _, _, d, b = tables(spark, 3)
    assert D.contamination(d.limit(0), b).count() == 0
    assert D.contamination(d, b.limit(0)).where("size(spans) > 0 or size(items) > 0").count() == 0


def test_repeated_item_ids(spark, monkeypatch):
    say = lambda a: " ".join(f"w{i}" for i in range(a, a + 10))
    items = [("x", say(0)), ("x", say(0)), ("x", say(20)), ("y", say(40)), (None, say(60)), (None, say(80))]
    docs = [(0, f"{say(0)} and {say(20)} and {say(40)}"), (1, f"{say(20)} {say(60)} {say(80)}"), (2, say(60))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for most in (D.BLOCK_BYTES, 60):
        monkeypatch.setattr(D, "BLOCK_BYTES", most)
        got = {r.doc_id: (sum(x.end - x.start for x in r.spans), sorted(r["items"])) for r in D.contamination(d, b).collect()}
        assert got == {0: (30, ["x", "y"]), 1: (30, ["x"]), 2: (10, [])}


def test_runs_of_one_word(spark):
    docs = [(0, "z " * 200_000), (1, "a " + "z " * 9 + "b"), (2, "z " * 30)]
    items = [(7, "z " * 10_000), (8, "z z"), (9, "y " * 3000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (sum(x.end - x.start for x in r.spans), sorted(r["items"])) for r in D.contamination(d, b).collect()}
    assert got == {0: (200_000, ["7", "8"]), 1: (9, ["8"]), 2: (30, ["7", "8"])}
    best = {(r.item_id, r.item_word): (r.length, r.doc_id) for r in D.longest_matches(d, b).collect()}
    assert len(best) == 9_991 + 1 and best["7", 0] == (10_000, 0) and best["7", 9_990][0] == 10 and best["8", 0][0] == 2
