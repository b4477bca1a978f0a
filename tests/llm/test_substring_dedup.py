import random

import pytest
from pyspark.sql import functions as F
from quillstone.llm.substring_dedup import deduplicate, repeats

from . import brute


def corpus(seed):
    rnd = random.Random(seed)
    say = lambda n: [rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(n)]
    passages = [say(n) for n in (9, 10, 12, 20, 41, 85)]
    docs = []
    for i in range(150):
        w = say(rnd.choice((0, 3, 15, 40)))
        for _ in range(rnd.randrange(3)):
            a = rnd.randrange(len(w) + 1)
            w[a:a] = rnd.choice(passages)
        if docs and rnd.random() < 0.2:
            w = list(brute.white(rnd.choice(docs)[1]))
        docs.append((i * 3, rnd.choice((" ", "\n", " \t ", "  ")).join(w)))
    rnd.shuffle(docs)
    return docs + [(1000, None), (1001, ""), (1002, "x " * 400), (1003, "x " * 300), (1004, "Ünï " * 9), (1005, "word " * 20000)]


@pytest.mark.parametrize("window", [10, 11])
def test_against_brute_force(spark, window):
    docs = corpus(window)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("at", F.lit("own")).repartition(4)
    got = {r.doc_id: (r.n_words, r.text, r.n_removed) for r in deduplicate(df, window).collect()}
    want = brute.without_repeats(docs, window)
    assert got == {d: (n, t, n - len(t.split())) for d, (n, t) in want.items()}


def test_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(None, t), (2, t), (2, t), (5, t + " z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in deduplicate(df, 10).collect()), key=str)
    assert got == [(2, t), (2, t), (5, "z"), (None, t)]
    assert deduplicate(df.limit(0), 10).count() == 0


def test_several_texts_of_one_id(spark):
    say = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = say("a"), say("b"), say("c")
    docs = [(3, a), (5, a), (5, b), (6, "x " + a), (6, f"{b} {c}"), (7, c), (7, c), (8, None), (9, a + " " + a)]
    got = sorted(((r.doc_id, r.n_words, r.text) for r in deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 60, a), (5, 60, ""), (5, 60, b), (6, 61, "x"), (6, 120, c), (7, 60, ""), (7, 60, ""), (8, 0, ""), (9, 120, "")], key=str)


def test_doubling(spark):
    docs = [(d, t) for d, t in corpus(3) if d < 600]
    got = {}
    for r in repeats(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect():
        got.setdefault(r.length, set()).add((r.doc_id, r.pos))
    length = 10
    while True:
        seen = {}
        for d, t in docs:
            w = brute.white(t)
            for i in range(len(w) - length + 1):
                seen.setdefault(tuple(w[i : i + length]), set()).add((d, i))
        want = {x for s in seen.values() if len({d for d, _ in s}) > 1 for x in s}
        assert got.get(length, set()) == want
        if not want:
            break
        length *= 2
    assert length > 40
