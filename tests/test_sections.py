import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.operators import lexical as L
from quillstone.operators import sections as S


@pytest.mark.parametrize("counted", [1, 50, 1 << 20])
def test_shared_terms_by_runs_of_any_size(monkeypatch, counted):
    monkeypatch.setattr(S, "COUNTED", counted)
    rnd = np.random.default_rng(3)
    norm = [" ".join(rnd.choice(list("abcdefghij"), rnd.integers(0, 7))) for _ in range(40)]
    section = np.repeat([0, 1, 2], [1, 25, 14])
    stop = np.array([1, 26, 40])[section]
    found = {(int(a), int(b)): int(n) for left, right, both, _ in S._shared(pa.array(norm), section, stop) for a, b, n in zip(left, right, both, strict=True)}
    sets = [set(x.split()) for x in norm]
    assert found == {(i, j): len(sets[i] & sets[j]) for i in range(40) for j in range(i + 1, 40) if section[i] == section[j] and sets[i] & sets[j]}


def test_change_pairs_shuffle_no_pair(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma 1 delta.\n\nAlpha beta gamma 2 delta.\n\nOmega only.")], "doc_id long, text string")
    pairs = L.change_pairs(L.units(L.sections(L.paragraphs(docs))))
    assert [(r.p1.paragraph, r.p2.paragraph) for r in pairs.collect()] == [(0, 1)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # every shared term was a joined row, and every pair met both units again
    near = L.like_pairs(L.units(L.sections(L.paragraphs(docs))), 0.5)
    assert near.count() == 1 and "Join" not in near._jdf.queryExecution().executedPlan().toString()
    assert L.change_pairs(L.units(L.sections(L.paragraphs(docs.where(F.lit(False)))))).count() == 0


def told(p):
    """Kind, left and right value of a pair of units, read list by list; nothing where they don't tell a change."""
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    apart = lambda a, b: next((x for x in a if x not in b), (a or [""])[0])
    kind, gone, come = None, "", ""
    for c, name in (("ds", "change-date"), ("ns", "change-number"), ("bs", "change-entity")):
        a, b = p[f"{c}1"], p[f"{c}2"]
        if a or b:
            return (name, plain(apart(a, b)), plain(apart(b, a))) if a and b and plain(apart(a, b)) != plain(apart(b, a)) else None
    a, b = p["seq1"], p["seq2"]
    n = min(len(a), len(b))
    pre = next((i for i in range(n) if a[i] != b[i]), n)
    suf = next((i for i in range(n - pre) if a[-1 - i] != b[-1 - i]), n - pre)
    gone, come = a[pre : len(a) - suf], b[pre : len(b) - suf]
    if not gone or not come:
        return ("change-insert" if come else "change-delete", " ".join(gone), " ".join(come))
    if len(gone) <= 3 and len(come) <= 3:
        return "change-replace", " ".join(gone), " ".join(come)
    gone, come = apart(p["terms1"], p["terms2"]), apart(p["terms2"], p["terms1"])
    return ("change-entity", gone, come) if gone != come else None


@pytest.fixture(scope="module")
def said(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "a", "b2"]
    signs = ["2024-03-05", "March 7, 2023", "$1,200", "1200", "5%", "3kg", "U.S.", "e.g.", "E.G."]

    def unit():
        line = [rnd.choice(words) for _ in range(rnd.randint(1, 9))]
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
            line.insert(rnd.randrange(len(line) + 1), rnd.choice(signs))
        return " ".join(line) + ". and so on"

    docs = [(i, "\n\n".join(unit() for _ in range(rnd.choice([1, 2, 30])))) for i in range(40)] + [(99, None), (98, "")]
    return L.sections(L.paragraphs(spark.createDataFrame(docs, "doc_id long, text string"))).cache()


@pytest.mark.parametrize("leaving", [7, 1 << 13])
def test_changes_against_lists(said, monkeypatch, leaving):
    """What changed was a column function of every pair, whose lists were read over and over: 1000 documents took more than a minute."""
    monkeypatch.setattr(S, "LEAVING", leaving)
    rows = L.units(said)
    want = set()
    for p in L.change_pairs(rows).collect():
        if t := told(p.asDict()):
            want.add((p.doc_id, p.section, *p.p1, *p.p2, *t, " ".join(p.norm1.split(" ")[:8]), p.similarity))
    got = [tuple(r) for r in L.changes(rows).collect()]
    assert len(got) == len(want) > 300 and set(got) == want and len({r[6] for r in got}) == len(S.KINDS)
    assert "Join" not in L.changes(rows)._jdf.queryExecution().executedPlan().toString()


def test_asked_changes_cut_only_texts_with_a_side(said, monkeypatch):
    """All texts were cut into units and met for a change of numbers, which texts without digits can't have."""
    every = L.changes(L.units(said))
    for asked in ("number changed", "date changed", "entity changed", "changed value 1200 -> 5", "changed value b2 to a"):
        found = L.asked_changes(said, asked)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, L.matching_changes(every, asked).collect()))
    cut, made = [], L.units
    monkeypatch.setattr(L, "units", lambda paras: cut.append(paras) or made(paras))
    assert L.asked_changes(said, "number changed").count() > 0
    assert 0 < cut[0].count() < said.count() and not cut[0].where("not text rlike '[0-9]'").count()


def test_likest_changes_alone_leave_a_task(said):
    """Every change was told, sent to Spark and sorted for the likest few."""
    rows = L.units(said.coalesce(1))
    order = lambda r: (-r[10], r[0], *r[2:6])
    every = sorted((tuple(r) for r in L.changes(rows).collect()), key=order)
    for n in (1, 5, 20, 10**6):
        assert [tuple(r) for r in L.top_changes(rows, n).collect()] == every[:n]
    assert L.changes(rows, 3).count() < len(every) / 2
