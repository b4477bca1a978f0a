import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quillstone.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(PATH)


def blob(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def points():
    return [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def samples():
    rng, every = random.Random(1), points()
    out = ["", " ", "  ", "\n\n a", "a<|endoftext|>b  <|endoftext|>", "  <|endoftext|>  x", "<|endoftext|><|endoftext|>", "a" * 3000, "aa" * 701 + "b", "'s's'll 're", "x'LL", "a \x1c b\x85　c", "ab \n" * 400_000]
    out += ["".join(chr(rng.choice(every)) if rng.random() < 0.3 else rng.choice("abcde  \n\t'stre123!?ÄéÉ中文αβ") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    return out + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.randint(1, 26)]) for _ in range(rng.randint(1, 40))) for _ in range(800)]


def test_ids_are_the_librarys(automaton, library):
    texts = samples()
    for text, ids in zip(texts, bpe.Encoder(automaton).ids(texts), strict=True):
        assert ids == blob(library, text), text[:60]
        assert bpe.spelled(automaton.labels, np.frombuffer(ids, "<u4")) == text == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_every_code_point(automaton, library):
    text = "".join(map(chr, points())) + "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in points()[::29])
    assert bpe.Encoder(automaton).ids([text]) == [blob(library, text)]


def test_paths_are_what_merging_gives(tmp_path):
    """Small vocabularies, whose merges meet in many ways: the path, a merge loop and the arcs of every other path agree."""
    for seed in range(6):
        rng = random.Random(seed)
        tokens, merges = list(bpe._byte_signs()), []
        parts = ["a", "b", "c"]
        while len(merges) < 14:
            a, b = rng.choice(parts), rng.choice(parts)
            if a + b not in parts:
                parts.append(a + b)
                merges.append((a, b))
        spec = json.loads(open(PATH).read())
        spec["added_tokens"] = []
        spec["model"]["vocab"] = {t: i for i, t in enumerate(tokens + [a + b for a, b in merges])}
        spec["model"]["merges"] = [list(m) for m in merges]
        (path := tmp_path / f"{seed}.json").write_text(json.dumps(spec))
        made = bpe.Automaton(str(path))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(15)]
        ids, size = made.encode([w.encode() for w in words])
        for w, own in zip(words, np.split(ids, np.cumsum(size)[:-1]), strict=True):
            seq = list(w)
            for a, b in merges:  # each merge in turn, from the left
                i = 0
                while i + 1 < len(seq):
                    if (seq[i], seq[i + 1]) == (a, b):
                        seq[i : i + 2] = [a + b]
                    i += 1
            assert [made.labels[i].decode() for i in own] == seq
            accepted, arcs = set(), [p for p in parts if spec["model"]["vocab"][p] in made.token]

            def walk(at, state, path, w=w, accepted=accepted):
                if at == len(w):
                    accepted.add(tuple(path))
                for p in arcs:
                    t = spec["model"]["vocab"][p]
                    if w.startswith(p, at) and made.follows(np.array([state]), np.array([t]))[0]:
                        walk(at + len(p), made.target[t], [*path, p])

            walk(0, 0, [])
            assert accepted == {tuple(seq)}


def test_columns_and_rows(spark, library):
    texts = [None, "", "one two  three\n", "one two  three\n", "x<|endoftext|>y", "Ж" * 5000]
    docs = spark.createDataFrame([(i, t, b"z", {"k": t or ""}) for i, t in enumerate(texts)], "doc_id int, text string, IDS binary, m map<string,string>")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert rows.columns == ["doc_id", "text", "m", "ids", "decoded"]
    for r in rows.collect():
        assert bytes(r.ids) == blob(library, r.text) and r.decoded == (r.text or "") and r.m == {"k": r.text or ""}
    assert bpe.decode(bpe.encode(docs.where("false"), PATH), PATH).collect() == []
    odd = spark.createDataFrame([(None,), (np.array([0xC3 - 94, 60000, 1 << 31, 50256], "<u4").tobytes(),)], "ids binary")
    assert {r.decoded for r in bpe.decode(odd, PATH).collect()} == {"", library.decode([0xC3 - 94, 50256], skip_special_tokens=False)}


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Automaton(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_tokenization_automaton(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert got == {r.doc_id: (len(b := blob(library, r.text)) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs}
