"""The incremental index against one built anew, and the truth fold a batch at a time against the whole fold."""

import hashlib
import re

import pytest

from quillstone.operators import postings as I
from quillstone.operators import truths as U
from quillstone.streaming import truths as S

ROWS = "record_id string, clock long, text string"


def brute(texts):
    """({(id, term): n}, {term: df}) by plain Python."""
    said = {}
    for i, text in texts.items():
        for t in re.findall("[a-z0-9]{3,}", (text or "").lower()):
            said[i, t] = said.get((i, t), 0) + 1
    df = {}
    for _, t in said:
        df[t] = df.get(t, 0) + 1
    return said, df


def plain(index):
    rows, df = index.postings.collect(), index.frequencies.collect()
    assert len({(r.record_id, r.term) for r in rows}) == len(rows) and len({r.term for r in df}) == len(df)
    return {(r.record_id, r.term): r.n for r in rows}, {r.term: r.df for r in df}


BATCHES = [
    [("a", 1, "one two three three"), ("b", 1, "two four"), ("c", 1, None), ("d", 1, ""), (None, 1, "lost")],
    [("a", 2, "three FIVE"), ("a", 1, "older words"), ("b", 1, None), ("e", 1, "four four")],
    [("b", 1, "two again"), ("a", 5, "three five"), ("e", 1, "tie beta"), ("e", 1, "tie alpha"), ("e", 1, "tie alpha"), ("z", 1, None)],
    [],
]


def test_index_follows_batches(spark, tmp_path):
    target, texts = str(tmp_path / "index"), {}
    whole = I.built(spark.createDataFrame([], ROWS))
    for n, batch in enumerate(BATCHES):
        touched = spark.createDataFrame(batch, ROWS).repartition(3)
        whole = I.updated(whole, touched)
        for _ in range(2):  # a batch that comes again changes nothing
            I.apply_batch(touched, n, target)
        best = {}
        for i, clock, text in batch:
            if i is not None:
                best[i] = max(best.get(i, (-1, "", None)), (clock, hashlib.sha256((text or "").encode()).hexdigest(), text), key=lambda x: x[:2])
        texts |= {i: b[2] for i, b in best.items()}
        assert plain(I.index(spark, target)) == plain(whole) == brute(texts)
    with pytest.raises(ValueError, match="doesn't follow"):
        I.apply_batch(spark.createDataFrame([], ROWS), 7, target)
    with pytest.raises(ValueError, match="no index"):
        I.index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="record_id"):
        I.apply_batch(spark.createDataFrame([(1.5, 1, "x")], "record_id double, clock long, text string"), 0, str(tmp_path / "other"))


WORDS = ["cache", "store", "files", "rows", "disk", "index", "table", "stream", "batch", "merge"]


def said(conv):
    """Statements that contradict, refine, supersede and repeat each other."""
    w = lambda i: WORDS[(conv * 7 + i * 3) % len(WORDS)]
    return [f"The {w(0)} {w(1)} is local {w(2)}.", f"Going forward the {w(0)} {w(1)} is remote {w(3)}.", f"The {w(1)} must never use the {w(4)} {w(2)}.", f"The {w(0)} {w(1)} is local {w(2)}.", f"We need {w(5)} {w(1)} with {w(0)}."]


def test_stream_of_truths(spark, tmp_path):
    rows = [(c, i, "user", t) for c in range(24) for i, t in enumerate(said(c) * 2)]
    schema = "conv_id long, turn long, role string, text string"
    whole = sorted(map(str, U.fold_truths(U.atomize(spark.createDataFrame(rows, schema), 2)).collect()))
    for n, part in enumerate((rows[:90], rows[90:100], [], rows[100:])):
        for _ in range(2):
            S.apply_batch(U.atomize(spark.createDataFrame(part, schema), 2), n, str(tmp_path / "t"))
    assert sorted(map(str, S.truths(spark, str(tmp_path / "t")).collect())) == whole
    assert len({s for r in S.truths(spark, str(tmp_path / "t")).collect() for s in [r.status]}) >= 3
    with pytest.raises(ValueError, match="doesn't follow"):
        S.apply_batch(U.atomize(spark.createDataFrame([], schema)), 9, str(tmp_path / "t"))


def test_truths_from_files(spark, tmp_path):
    schema, rows = "conv_id long, turn long, role string, text string", []
    for c in range(3):
        part = [(c, i, "user", t) for i, t in enumerate(said(c))]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{c}"))
        rows += part
    source = str(tmp_path / "in/*")
    S.fold(spark, source, str(tmp_path / "t"), str(tmp_path / "check")).awaitTermination()
    got = S.truths(spark, str(tmp_path / "t"))
    assert got.count() == U.fold_truths(U.atomize(spark.createDataFrame(rows, schema))).count()
