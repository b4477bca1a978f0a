"""Exports in files and archives, read as streams."""

import io
import json
import zipfile

import pytest

from quillstone.sources import archives as A
from quillstone.sources import exports as X


def text_of(data: bytes, step: int = 7):
    stream = io.BytesIO(data)
    return A._Text(lambda n: stream.read(min(n, step)))


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_runs_are_the_elements(step, most):
    values = [{"a": "é\\\"]},[", "b": [1, [2, {}]]}, 12, 3.5e3, "x" * 500, None, True, [], {"t": "中\n"}]
    for given in (values, [], values[:1], [1234567]):
        for data in (json.dumps(given, ensure_ascii=False), json.dumps(given, indent=3)):
            got = list(A.json_runs(text_of(b"\xef\xbb\xbf " + data.encode() + b" \n", step), most))
            assert [v for _, run in got for v in json.loads(run)] == given
            at = 0
            for first, run in got:
                assert first == at
                at += len(json.loads(run))


@pytest.mark.parametrize("data", ["[1, 2", "[1 2]", '[{"a": 1]', "[1,]", "[1] x", "[,1]", '["abc', "", "nothing", '{"a": 1} x'])
def test_broken_text_is_an_error(data):
    with pytest.raises(ValueError):
        list(A.json_runs(text_of(data.encode()), 1))


def test_a_list_is_not_held_whole():
    """64 MB of elements: what is held at once is a read and an element."""
    element = json.dumps({"t": "x" * 10_000}).encode() + b","
    n, left = 6500, [b"[" + element]

    def read(size, sent=[0]):  # noqa: B006
        out = b"".join(left)
        left.clear()
        while len(out) < size and sent[0] < n:
            out, sent[0] = out + element * 50, sent[0] + 50
        if sent[0] >= n and not left and read.end:
            out, read.end = out + b"1]", False
        return out

    read.end = True
    source = A._Text(read)
    assert sum(len(json.loads(run)) for _, run in A.json_runs(source, 1 << 20)) == n + 2
    assert source.longest < 4 << 20


def claude(i, n=2):
    return {"uuid": f"c{i}", "name": "Claude Project", "chat_messages": [{"uuid": f"m{j}", "sender": "human" if j % 2 == 0 else "assistant", "text": f"hello {i} {j}" + "x" * 150_000} for j in range(n)]}


GEMINI = {"title": "Gemini Project", "messages": [{"id": "g1", "role": "user", "parts": [{"text": "hello gemini"}]}, {"id": "g2", "role": "model", "parts": [{"text": "hello user"}]}]}


def test_archives(spark, tmp_path):
    """Entries in several rows keep their places; other and broken entries, and what is no JSON, are passed over."""
    with zipfile.ZipFile(tmp_path / "export one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("claude/conversations.json", json.dumps([claude(i) for i in range(40)]))
        z.writestr("gemini.json", "﻿" + json.dumps([GEMINI] * 3))
        z.writestr("broken.json", json.dumps([claude(99)])[:-1])
        z.writestr("users.json", json.dumps({"users": [1]}))
        z.writestr("readme.txt", "[1]")
    (tmp_path / "source.json").write_text(json.dumps({"format": "X_SOURCE_ENVELOPE", "version": 2, "provider": "copilot", "conversationExternalId": "copilot-1", "messages": [{"externalId": "c1", "sequence": 0, "role": "user", "text": "hello"}]}))
    assert X.read_files(spark, str(tmp_path)).where("name like '%/claude/%' and first > 0").count() >= 2
    rows = X.read_conversations(spark, str(tmp_path)).collect()
    assert {(r.conversation_id, r.sequence, r.text.rstrip("x")) for r in rows if r.provider == "claude"} == {(f"c{i}", j, f"hello {i} {j}") for i in range(40) for j in range(2)}
    assert {r.conversation_id for r in rows if r.provider == "gemini"} == {f"export one.zip/gemini.json-{i}" for i in range(3)}
    assert [(r.provider, r.role, r.text) for r in rows if r.conversation_id == "copilot-1"] == [("copilot", "user", "hello")] and len(rows) == 87


def test_nothing_found_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("users.json", "[]")
    with pytest.raises(ValueError, match="no conversations"):
        X.read_conversations(spark, str(tmp_path))
    (tmp_path / "b.json").write_text("[1, 2")
    with pytest.raises(Exception, match="breaks off"):
        X.read_files(spark, str(tmp_path)).collect()


def test_a_mapping_comes_by_time(spark):
    """Messages without a time come first."""
    def node(i, time, text):
        return {"message": {"id": i, "author": {"role": "user"}, "content": {"parts": [text]}} | ({"create_time": time} if time is not None else {})}

    mapping = {"a": node("m9", 1700000300.5, "third"), "b": node("m2", 1700000100, "second"), "c": node("m8", None, "first"), "d": node("m1", 1700000300.7, "fourth"), "e": {"message": None}}
    files = spark.createDataFrame([("chatgpt.json", json.dumps([{"id": "x", "mapping": mapping}]))], "name string, content string")
    assert [r.text for r in X.normalised(files).orderBy("sequence").collect()] == ["first", "second", "third", "fourth"]


def test_a_digest_as_zip(spark, tmp_path):
    """Entries of several tasks in one archive, by path; unsafe paths stay inside; no rows make an empty archive."""
    from quillstone.sources.zips import write_zip

    rows = [(f"topics/é{i:03d}.md", f"# {i}\n" * i) for i in range(200)] + [("../up/./x.md", "up"), ("same.md", "1"), ("same.md", "2"), ("none.md", None), (None, "gone")]
    path = str(tmp_path / "out dir" / "digest.zip")
    got = write_zip(spark.createDataFrame(rows, "path string, content string").repartition(4), path).first()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and got.n == len(z.namelist()) == 204 and z.namelist() == sorted(z.namelist())
        assert all(z.read(p).decode() == c for p, c in rows[:200]) and z.read("up/x.md") == b"up" and z.read("none.md") == b""
        assert [z.read(i).decode() for i in z.infolist() if i.filename == "same.md"] == ["1", "2"]
    assert got.bytes == (tmp_path / "out dir" / "digest.zip").stat().st_size and len(list((tmp_path / "out dir").iterdir())) <= 2  # a checksum file of Hadoop's at most
    empty = write_zip(spark.createDataFrame([], "path string, content string"), str(tmp_path / "empty.zip")).first()
    with zipfile.ZipFile(tmp_path / "empty.zip") as z:
        assert z.namelist() == [] and empty.n == 0
