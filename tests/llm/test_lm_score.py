import math
import random
from collections import Counter

from quillstone.llm.lm_score import PRIOR, score

from .brute import lower, white


def brute(docs, targets):
    """{doc_id: (n_tokens, target_unats, background_unats)}"""
    runs = [(d, [*white(lower(t)), ""]) for d, t in docs]
    word, pair, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for d, w in runs:
        for m in (0, 1) if d in targets else (0,):
            word[m].update(w)
            pair[m].update(zip(["", *w], w))
            total[m] += len(w)
    out = {}
    for d, w in runs:
        sums = [0, 0]
        for m in (0, 1):
            for a, b in zip(["", *w], w):
                base = (word[m][b] + 1.0) / (total[m] + len(word[0]))
                sums[m] += round(-math.log((pair[m][a, b] + PRIOR * base) / (word[m][a] + PRIOR)) * 1e6)
        out[d] = (len(w), sums[1], sums[0])
    return out


def rows(df):
    return {r.doc_id: (r.n_tokens, r.target_unats, r.background_unats) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Über", "X"]
    docs = [(i, " ".join(rnd.choice(vocab[: 20 + 20 * (i % 3)]) for _ in range(rnd.choice((0, 1, 5, 50, 300))))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one " * 20000), (204, "x"), (205, "x")]
    df = spark.createDataFrame([(a, b, "t") for a, b in docs], "doc_id long, text string, `__text` string").repartition(4)
    chosen = spark.createDataFrame([(i,) for i in [*range(0, 120, 3), 0, 999, None, 204]], "doc_id long")
    got = score(df, chosen)
    assert rows(got) == brute(docs, {*range(0, 120, 3), 204})
    for r in got.collect():
        assert r.score == (r.target_unats - r.background_unats) / r.n_tokens / 1e6


def test_target_texts_score_lower(spark):
    docs = [(i, ("red green blue " if i % 2 else "uno dos tres ") * (3 + i)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(df, df.where("doc_id % 2 = 1 and doc_id < 10").select("doc_id")).collect()}
    assert max(v for k, v in got.items() if k % 2) < min(v for k, v in got.items() if not k % 2)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    none = df.limit(0).select("doc_id")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in score(df, none).collect()) == [(0, 3), (1, 3), (1, 3)]
    assert score(df.limit(0), none).count() == 0
