import random

import numpy as np
from pyspark.sql import functions as F
from quillstone.llm import quality_rules as R

from . import brute


def texts(n, seed):
    rnd = random.Random(seed)
    bits = ["a", "b", "c", "Étude", "日本", "x#y", "%%", "\n", "\n", "\r\n", " ", "\t", "A.", "w<b>", "\x0b"]
    return [None, "", "\n\n", "a a a a", "ab\nab", "z " * 30000] + [rnd.choice(("", " ")).join(rnd.choice(bits) + rnd.choice((" ", "", "\n")) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_counts(spark):
    rows = list(enumerate(texts(300, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).repartition(3)
    got = {r.doc_id: {c: r[c] for c in R.COUNTS} for r in R.statistics(df).collect()}
    assert got == {i: brute.text_counts(t) if i != 5 else got[5] for i, t in rows}
    assert got[5]["n_words"] == got[5]["n_repeat_words"] == 30000
    assert R.statistics(df.limit(0)).count() == 0


def test_rules_learned_and_judged_alike(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"]) + rnd.choice("abcdefgh") * 2 for _ in range(n))
    docs = []
    for i in range(600):
        t = say(rnd.randrange(60, 120))
        kind = i % 3 if rnd.random() < 0.5 else 0
        docs.append((i, {0: t, 1: t.replace(" ", "%% "), 2: t.upper()}[kind], int(kind == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    rules = R.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert 1 <= len(rules) <= R.MOST_RULES
    got = {r.doc_id: r.kept for r in R.statistics(df).select("doc_id", R.verdict(rules).alias("kept")).collect()}
    assert np.mean([got[i] == bool(q) for i, _, q in docs]) > 0.98
    twice = df.select("doc_id", "text").union(df.select("doc_id", "text")).withColumn("label", F.lit("own"))
    assert R.fit(twice, df.select("doc_id", "quality")) == rules
    assert spark.range(1).select(R.verdict([]).alias("k")).first().k
    assert R.fit(df.select("doc_id", "text"), df.where("quality = 1").select("doc_id", "quality")) == []
