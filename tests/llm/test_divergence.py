import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from quillstone.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, RANK map<string,int>"


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for lang, n, sources in (("en", 500, 23), ("Ж", 120, 6), (None, 60, 3), ("few", 5, 4)):
        for _ in range(n):
            s = 0 if rng.random() < 0.4 else rng.randrange(sources)
            own = [f"Own{'abcdefghijklmnopqrstuvw'[s]}", "THE", "the", "é中", "of"] + ["rare" + "abcdefghijklmnopqrstuvwxyz"[rng.randrange(26)]] * 2
            out.append((" ".join(rng.choice(own) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", "-7x_"]), lang, f"s{s}" if s else None))
    return out + [(None, "en", "empty"), ("", "en", "empty"), ("the " * 70000, "en", "s1"), ("twice a", "de", "z"), ("twice a", "de", "z")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", {"a": 1}) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("share", "terms", "groups"), [(4, 512, 256), (1, 4, 5), (2, 3, 4)])
def test_against_plain_python(spark, rows, monkeypatch, share, terms, groups):
    """Also all light (1), and with tiles far smaller than a language."""
    monkeypatch.setattr(D, "HEAVY_SHARE", share)
    monkeypatch.setattr(D, "TILE_TERMS", terms)
    monkeypatch.setattr(D, "TILE_GROUPS", groups)
    got = [tuple(r) for r in D.divergence(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_other_limits_and_no_rows(spark, rows):
    assert {tuple(r) for r in D.divergence(frame(spark, rows), least_docs=40, top=2).collect()} == brute(rows, 40, 2)
    assert D.divergence(frame(spark, rows).where("false")).collect() == []


def test_sql(rows):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    assert set(db.execute(D.OP13_SQL).fetchall()) == brute(rows)


def test_shares_beyond_64_bits(spark):
    n, total = 10**13, 3 * 10**13
    got = spark.range(1).select(D.share(D.F.lit(n), D.F.lit(total), D.F.lit(7))).collect()[0][0]
    assert got == 1 + 10**9 * (n + 2) // (total + 14)
