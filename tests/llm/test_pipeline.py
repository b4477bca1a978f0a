import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from . import brute

DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    docs = start = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == columns
            got = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            assert len(got) > 0.7 * len(texts) and got.items() <= texts.items()
        if name == "near_duplicates":
            assert got == {d: t for d, t in texts.items() if brute.components(list(texts.items()))[d][1] == d}
        if name == "decontamination":
            bad = brute.contaminated(list(texts.items()), items)
            assert got == {d: t for d, t in texts.items() if not bad[d][1]}
        if name == "secrets":
            assert got.keys() == texts.keys()
            for d, t in got.items():
                assert not brute.base_spans(t), d
                assert t == texts[d] or "[SECRET]" in t
        if name == "packing":
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            rows = {(r.doc_id, r.piece): r for r in out.collect()}
            for d, t in texts.items():
                ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
                for p in range(-(-len(ids) // 4096)):
                    assert rows.pop((d, p)).ids_crc32 == zlib.crc32(ids[4096 * p : 4096 * (p + 1)].tobytes())
            assert not rows
        else:
            docs, texts = out, got
    assert start.count() > docs.count()


def test_secrets_are_judged_by_the_model_of_op6(spark, monkeypatch):
    docs, found = spark.read.parquet(f"{DIR}/documents.parquet"), []
    want = P.secrets.train(P.secrets.default_samples(docs))
    train = P.secrets.train
    monkeypatch.setattr(P.secrets, "train", lambda samples: found.append(train(samples)) or found[-1])
    P.blank_secrets(spark, docs.limit(3), DIR)
    assert found == [want]
