"""The queries that SQL can't express, over the whole smallest tables, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillstone.llm import quality as Q
from quillstone.llm import quality_rules as R
from quillstone.llm import secrets as S
from quillstone.llm import toxicity as T
from quillstone.llm import words as W
from quillstone.llm.labelled import fold

from .brute import base_spans, text_counts

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels")]


def scaled(m, logit, cut):
    return 1 / (1 + np.exp(-np.clip((logit - m.shift) * m.scale + np.log(cut / (1 - cut)), -30, 30)))


def rest(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_op3(spark, tables):
    docs, labels = tables
    model = Q.fit(docs, labels, F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    got = {r.doc_id: r for r in Q.op3_subword_quality(spark, DIR).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        total = 0.0
        for w in words:
            buckets, _ = Q.features([w.encode()])
            total += float(np.mean(model.value[buckets], dtype=np.float64))
        hashes = W.split(pa.array([r.text])).hash
        pairs = [int(W.mix(np.array([(int(a) * int(W.ODD) + int(b)) % (1 << 64)], np.uint64))[0]) % Q.BUCKETS for a, b in zip(hashes, hashes[1:])]
        total += float(sum(model.value[b] for b in pairs))
        score = scaled(model, total / max(1, len(words) + len(pairs)) + model.bias, Q.CUT)
        own = got[r.doc_id]
        assert abs(own.score - score) < 1e-4 and own.predicted == int(own.score >= 0.3) and own.held_out == (rest(r.doc_id, 5) == 0)


def test_op10(spark, tables):
    docs, labels = tables
    model, cuts = T.fit(docs, labels, F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    got = {r.doc_id: r for r in T.op10_cnn_toxicity(spark, DIR).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        ids = T._ids(W.split(pa.array([r.text]), W.ALNUM, lower=True))
        add = model.table[ids].astype(np.float64).sum(1) if len(ids) else np.zeros((0, model.table.shape[1]))
        pooled, col = [], 0
        for width in T.WIDTHS:
            best = np.zeros(T.FILTERS) if not len(add) else np.max([sum(add[p + j, col + j * T.FILTERS : col + (j + 1) * T.FILTERS] for j in range(width) if p + j < len(add)) for p in range(len(add))], axis=0)
            pooled.append(best)
            col += width * T.FILTERS
        pooled = np.maximum(np.concatenate(pooled) + model.bias, 0)
        own = got[r.doc_id]
        assert abs(own.score - scaled(model, float(pooled @ model.out + model.out_bias), T.CUT)) < 1e-4
        assert own.held_out == (rest(r.doc_id, 4) == 2) and own.predicted == int(own.score >= 0.3) and own.threshold == cuts.get(r.lang, 0.3) and own.toxic == (own.score >= own.threshold)


def test_op6(spark, tables):
    docs, _ = tables
    table = S.train(S.default_samples(docs))
    n, places = len(S.ALPHABET), {c: i for i, c in enumerate(S.ALPHABET)}
    got = {r.doc_id: r for r in S.op6_markov_secrets(spark, DIR).collect()}
    for r in docs.collect():
        text = r.text or ""
        base = base_spans(text)
        markov = []
        for m in re.finditer(f"{S.TOKEN}{{{S.LEAST_TOKEN},}}", text):
            if sum(table[places[a] * n + places[b]] for a, b in zip(m[0], m[0][1:])) > S.LOG_ODDS:
                markov.append((m.start(), len(S.BASE), "markov", m.end()))
        say = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        own = got[r.doc_id]
        assert own.spans == say(base + markov) and own.base_sha256 == hashlib.sha256(say(base).encode()).hexdigest()
        assert (own.n_assign, own.n_access, own.n_hex) == tuple(sum(k == kind for _, _, k, _ in base) for kind in ("assign", "access", "hex"))


def test_op7(spark, tables):
    docs, labels = tables
    rules = R.fit(docs, labels)
    got = {r.doc_id: r for r in R.op7_decision_list_rules(spark, DIR).collect()}
    for r in docs.collect():
        c = text_counts(r.text)
        words, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
        x = {"n_words": c["n_words"], "mean_word": c["word_chars"] / words, "symbols": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"] / lines, "repeats": c["n_repeat_words"] / words, "upper": c["n_upper"] / chars, "stops": c["n_stops"] / words}
        bad = any(all((x[f] >= cut) if sign == ">=" else (x[f] < cut) for f, sign, cut in rule) for rule in rules)
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        own = got[r.doc_id]
        assert all(own[k] == c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert own.base_failed == failed and own.kept == (not failed and not bad)
