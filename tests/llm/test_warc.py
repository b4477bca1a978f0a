import base64
import gzip
import hashlib
import io
import zlib

import pytest
from quillstone.llm import warc
from quillstone.llm.store import Work


def expected(pages):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    most = {}
    for p, _, h in pages:
        if p is not None:
            most[h or ""] = max(p, most.get(h or "", p))
    out = []
    for p, _, h in pages:
        again = p is not None and p < most[h or ""]
        out.append((p, len((h or "").encode()), digest(h), "revisit" if again else "response", most[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = [(i, f"http://a/{i}\r\nX: y" if i % 5 else None, ["same", None, "", "é\r\n\r\nWARC/1.1\r\n" * i, "x" * (i * 3000), f"own {i}"][i % 6]) for i in range(90)]
    pages += [(None, "u", "same"), (None, "u", "only here"), (89, "again", "x"), (7, "u", "seven")]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, keeper int, digest string").repartition(3)
    back = warc.round_trip(df).cache()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()), key=str) == expected(pages)
    html = {(r.page_id, r.html) for r in back.where("record_type = 'response'").collect()}
    assert html <= {(p, h or "") for p, _, h in pages}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_one_stream_becomes_members_with_an_index(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "text " * i) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    work = Work(spark, "warc")
    raw = warc.write_archives(work, df, 4000)
    files = spark.read.format("binaryFile").load(raw).collect()
    assert len(files) > 1
    for f in files:
        engine = zlib.decompressobj(31)
        engine.decompress(bytes(f.content))
        assert engine.eof and not engine.unused_data  # one stream
    folder = warc.normalise(work, raw)
    index = spark.read.schema(warc.INDEX).option("pathGlobFilter", "*.idx").json(folder).collect()
    content = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).collect()}
    assert len(index) == 40
    for r in index:
        one = gzip.decompress(content[r.archive][r.offset : r.offset + r.length])
        assert one.startswith(b"WARC/1.1") and r.record_id.encode() in one and one.count(b"WARC-Record-ID") == 1
    again = warc.normalise(Work(spark, "warc"), folder)  # members in, members out
    assert warc.read_archives(spark, again).count() == 40


def test_broken_archives_are_errors(spark):
    whole = gzip.compress(warc.record(1, "u", b"payload" * 100, None))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(whole[:-20]))))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n")))))


def test_streams_of_any_cut():
    whole = b"".join(warc.record(i, "u", b"payload" * (i * 40_000), None) for i in range(4))
    for data in (gzip.compress(whole), b"".join(gzip.compress(whole[a : a + 300_001]) for a in range(0, len(whole), 300_001))):
        pieces = list(warc.inflate(io.BytesIO(data)))
        assert b"".join(pieces) == whole and max(map(len, pieces)) <= warc.PIECE
    assert list(warc.inflate(io.BytesIO(b""))) == []
