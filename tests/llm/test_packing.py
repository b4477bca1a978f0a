import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillstone.llm import packing
from quillstone.llm.packing import LANE_PIECES, fit, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    """Sequences are gapless from 0 and within the capacity; returns how many there are."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        ok = [g for g in gaps if g >= n]
        if ok:
            gaps.remove(min(ok))
        gaps.append((min(ok) if ok else capacity) - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_fit(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    rows, seen = [], {}
    plan, left, opened = fit(counts, 40)
    for length, rank, n, each, first, gap in plan.tolist():
        for k in range(n):
            rows.append((first + k // each, 40 - gap + k % each * length, length))
            seen.setdefault(length, set()).add(rank + k)
    assert seen == {n: set(range(c)) for n, c in counts.items()}
    assert check(rows, 40) == best_fit(lengths, 40) == opened
    assert sum(g * n for g, runs in left.items() for _, n in runs) == 40 * opened - sum(lengths)


@pytest.mark.parametrize("lane", [LANE_PIECES, 12])
def test_pack(spark, monkeypatch, lane):
    monkeypatch.setattr(packing, "LANE_PIECES", lane)
    monkeypatch.setattr(packing, "LANES_EACH", 4)
    rnd = random.Random(3)
    say = lambda n: "".join(rnd.choice(["the ", "Ünder ", "don't ", "x1-y2\n", "<|endoftext|> ", "日本 ", "été  ", " a "]) for _ in range(n))
    docs = [(i, say(rnd.choice((0, 1, 30, 400)))) for i in range(80)] + [(90, None), (90, None), (None, "the end"), (91, say(5000))]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, lane int, kind string").repartition(3)
    got = pack(df, PATH, 256).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 256)):
            x = np.array(ids[a : a + 256], "<u4")
            want.append((d, p, a, len(x), zlib.crc32(x.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    used, least = check([(r.sequence_id, r.offset, r.length) for r in got], 256), best_fit([w[3] for w in want], 256)
    assert used == least if lane == LANE_PIECES else used <= least + 2
    assert pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001/documents.parquet"])
def test_words_are_tokenised_alone(table):
    import pyarrow.parquet as pq
    from quillstone.llm.packing import WordTokens

    texts = pq.read_table(table)["text"]
    odd = ["it's o'clock 'tis", "<|endoftext|>x<|startoftext|>y z", "a…!b", "x=\u0338y e\u0301t", "A1b2-c_d.e", "ǅ İstanbul ΣΑΣ", "<a>it's</a>"]
    texts = pa.chunked_array([pa.array(odd), *texts.chunks])
    tokens = WordTokens(PATH)
    w = tokens.parts(texts)
    ids, size = tokens.ids(w)
    per = np.concatenate([[0], np.cumsum(size)])[w.first]
    for i, e in enumerate(Tokenizer.from_file(PATH).encode_batch(texts.to_pylist(), add_special_tokens=False)):
        assert ids[per[i] : per[i + 1]].tolist() == e.ids
