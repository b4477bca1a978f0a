import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from quillstone.llm import fill_middle as M

SCHEMA = "doc_id long, text string, N string, output binary, restored map<string,int>"


def brute(i, t, seed=7, rate=100, spm=50):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= rate:
        return len(units), "plain", None, None, t
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = [None, "", "\n", "\n\n", "a", "a\n", "a\x00b\nc", "<P>", "x<M>\n", "<\nS>", "a<", "<S", "\r\n\r\n é\n😀\n", "line é\n" * 50000, "x" * 3_000_000]
    made = odd + ["".join(rng.choice("ab\n\n<>PSMé😀\x00\x0b ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [(None, "a\nb\n"), (-3, "a\nb\n"), *enumerate(made), (20, "same\nrow"), (20, "same\nrow")]


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (1, 60, 0), (2, 100, 100)])
def test_against_plain_python(spark, texts, seed, rate, spm):
    docs = spark.createDataFrame([(i, t, "mine", b"x", {"a": 1}) for i, t in texts], SCHEMA)
    rows = M.restore(M.fill_in_middle(docs, seed=seed, rate=rate, spm=spm))
    assert rows.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [tuple(r) for r in rows.collect()]
    want = [(i, t, *brute(i, t, seed, rate, spm), t or "") for i, t in texts]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.restore(M.fill_in_middle(empty)).collect() == []
    one = spark.createDataFrame([("x\ny", "7", 1)], "body string, b string, n int")
    r = M.fill_in_middle(one, id_col="b", text_col="body").collect()[0]
    assert (r["b"], r.body, r.n) == ("7", "x\ny", 2)


def test_sql(texts):
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([i for i, _ in texts], pa.int64()), "text": [t for _, t in texts]}))
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = [(i, *(b := brute(i, t))[:4], sha(b[4]), sha(t)) for i, t in texts]
    assert sorted(db.execute(M.OP11_SQL).fetchall(), key=repr) == sorted(want, key=repr)
