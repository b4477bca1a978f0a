"""Chained change logs: forged entries, gaps, replays, forks, deletions, and states written whole now and then."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstone.streaming import replication as S

SCHEMA = "origin string, sequence long, record_id string, payload string, payload_hash string, memory_root string, type string, entity_type string, parents array<string>, hash string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def entry(origin, sequence, record, payload, parent=None, root="home", kind="put"):
    """A valid entry by plain Python: JSON with sorted keys and no white space."""
    parents = [] if parent is None else [parent[-1]]
    fields = {"memoryRoot": root, "originDeviceId": origin, "originSequence": sequence, "type": kind, "entityType": "note", "entityId": record, "payloadHash": sha(payload or ""), "parents": parents}
    return (origin, sequence, record, payload, sha(payload or ""), root, kind, "note", parents, sha(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))


def chain(origin, payloads, first=1, parent=None):
    out = []
    for i, (record, payload) in enumerate(payloads):
        out.append(entry(origin, first + i, record, payload, out[-1] if out else parent))
    return out


def changed(e, **fields):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple(fields.get(n, v) for n, v in zip(names, e, strict=True))


class Log:
    def __init__(self, spark, target):
        self.spark, self.target, self.n = spark, target, 0

    def send(self, rows, again=1):
        for _ in range(again):
            S.apply_batch(self.spark.createDataFrame(rows, SCHEMA).repartition(2), self.n, self.target, root="home")
        self.n += 1
        kept = {r.record_id: r.payload for r in S.state(self.spark, self.target).collect()}
        return kept, {(r.origin, r.sequence, r.reason) for r in S.rejected(self.spark, self.target).collect()}


def test_chain(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    a = chain("a", [("r", "öne / \"two\""), ("s", "x"), ("r", "three"), ("t", ""), ("s", None)])
    assert log.send(a[:2], again=2) == ({"r": "öne / \"two\"", "s": "x"}, set())
    # an entry with another payload, one with another payload and its hash, one of another root, one without a record
    forged = [changed(a[2], payload="evil"), changed(a[2], payload="evil", payload_hash=sha("evil")), entry("b", 1, "r", "foreign", root="else"), changed(a[2], record_id=None)]
    kept, bad = log.send(forged)
    assert kept == {"r": "öne / \"two\"", "s": "x"}
    assert bad == {("a", 3, "payload"), ("a", 3, "envelope"), ("b", 1, "root"), ("a", 3, "missing")}
    # a replay changes nothing; what follows a gap waits, and so does what follows that
    assert log.send([a[0], a[1], a[3], a[4]]) == (kept, {("a", 4, "gap"), ("a", 5, "waiting")})
    # a fork: valid by itself, but its parent isn't the entry before
    fork = entry("a", 3, "r", "fork", a[0])
    assert log.send([fork]) == (kept, {("a", 3, "parent")})
    assert log.send([a[2], a[2], a[3], a[4], forged[0]])[0] == {"r": "three", "t": ""}  # s is deleted
    assert [(r.origin, r.cursor, r.head) for r in S.cursors(spark, log.target).collect()] == [("a", 5, a[4][-1])]
    assert log.send([]) == ({"r": "three", "t": ""}, set())
    with pytest.raises(ValueError, match="doesn't follow"):
        S.apply_batch(spark.createDataFrame([], SCHEMA), 40, log.target)
    with pytest.raises(ValueError, match="no batch"):
        S.state(spark, str(tmp_path / "none"))


def test_whole_states(spark, tmp_path, monkeypatch):
    """With a whole state each second batch, old folders go and the state stays what all batches make of it."""
    monkeypatch.setattr(S, "COMPACTED", 2)
    log, rows = Log(spark, str(tmp_path / "log")), chain("a", [(f"r{i % 3}", None if i == 4 else f"v{i}") for i in range(7)])
    want = {}
    for e in rows:
        want[e[2]] = e[3]
        assert log.send([e]) == ({k: v for k, v in want.items() if v is not None}, set())
    assert len(list((tmp_path / "log/changes").glob("batch=*"))) <= 5 and len(list((tmp_path / "log/cursors").glob("batch=*"))) == 2


def test_two_valid_entries_of_one_place(spark, tmp_path):
    one, two = entry("a", 1, "r", "one"), entry("a", 1, "r", "two")
    kept = [S.chained(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "origin string, cursor long, head string")).where("reason is null").count() for rows in ([one], [two])]
    assert kept == [1, 1]
    for n, rows in enumerate(([one, two], [two, one])):
        S.apply_batch(spark.createDataFrame(rows, SCHEMA), 0, str(tmp_path / str(n)))
    assert len({S.state(spark, str(tmp_path / str(n))).first().payload for n in (0, 1)}) == 1
    assert S.verified(spark.createDataFrame([one], SCHEMA).withColumn("type", F.lit("other"))).count() == 0
