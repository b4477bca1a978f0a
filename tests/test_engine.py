import hashlib
import inspect
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import conversations as C
from quillstone.operators import records as R
from quillstone.sources import exports
from quillstone.streaming import replication


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_identity_ignores_case_and_white_space(spark):
    a = one(spark, T.canonical_id("x", "1", F.col("a"), F.col("b")), a="A", b=" B  C ")
    assert a == one(spark, T.canonical_id("x", "1", F.col("a"), F.col("b")), a="a", b="b c")
    assert a == "x_" + hashlib.sha256("1␟a␟b c".encode()).hexdigest()[:24]


@pytest.mark.parametrize(("text", "kind", "value", "polarity"), [
    ("We decided the store is Parquet", "decision", "Parquet", "NEUTRAL"), ("It must never be slow", "constraint", "slow", "NEGATIVE"), ("Next fix it", "task", None, "NEUTRAL"),
    ("Perhaps it is late", "hypothesis", None, "NEUTRAL"), ("Mustard is yellow", "fact", "yellow", "NEUTRAL"),
])
def test_statements(spark, text, kind, value, polarity):
    rows = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")
    r = C.statements(C.messages(rows)).first()
    assert (r.kind, r.value, r.polarity) == (kind, value, polarity)


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("a")), a=" One here.  Two there! No.\nYes ok? ") == ["One here.", "Two there!", "Yes ok?"]
    assert one(spark, T.sentences(F.col("a")), a=" No. ") == ["No."]
    assert one(spark, T.sentences(F.col("a")), a=" ") == []


def test_merge_is_commutative(spark):
    a = spark.createDataFrame([(1, "t1", "x"), (2, "t5", "y"), (3, "t2", "p")], "k int, clock string, body string")
    b = spark.createDataFrame([(1, "t2", "z"), (2, "t4", "w"), (3, "t2", "q"), (4, None, "n")], "k int, clock string, body string")
    left, right = (sorted(map(tuple, R.merge(*p, "k", "clock", "body").collect())) for p in ((a, b), (b, a)))
    assert left == right and left[:2] == [(1, "t2", "z"), (2, "t5", "y")] and len(left) == 4


def test_gaps(spark):
    log = spark.createDataFrame([("a", 5), ("a", 6), ("a", 9), ("b", 1)], "origin string, sequence long")
    assert [tuple(r) for r in R.gaps(log).collect()] == [("a", 9, 6)]


def test_exports(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"uuid": "u", "name": "n", "created_at": "", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hi"}, {"uuid": "2", "sender": "assistant", "text": " "}, {"uuid": "3", "sender": "bot", "text": "yo"}]}]))
    assert [(r.sequence, r.role, r.text) for r in exports.chat_messages(spark, str(tmp_path / "c.json")).orderBy("sequence").collect()] == [(0, "user", "hi"), (1, "assistant", "yo")]
    (tmp_path / "g.json").write_text(json.dumps([{"id": "g", "title": "t", "messages": [{"id": "1", "role": "model", "parts": [{"text": "a"}, {"text": "b"}]}]}]))
    assert [(r.provider, r.role, r.text) for r in exports.part_messages(spark, str(tmp_path / "g.json")).collect()] == [("gemini", "assistant", "a\nb")]
    (tmp_path / "e.json").write_text(json.dumps({"format": "own", "version": 2, "provider": "Copilot", "messages": [{"externalId": "1", "sequence": 0, "role": "prompt", "text": "q"}]}))
    assert [(r.provider, r.conversation_id, r.role) for r in exports.envelope_messages(spark, str(tmp_path / "e.json"), "own").collect()] == [("copilot", "conversation", "user")]


def test_replication_is_idempotent(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("a", 1, "r", "one", sha("one")), ("a", 2, "r", "two", sha("two")), ("b", 1, "s", "bad", sha("other")), ("b", 2, "s", "ok", sha("ok")), ("c", 1, "t", "gone", sha("gone")), ("c", 2, "t", None, sha("")), ("a", 9, "r", "after a gap", sha("after a gap"))]
    schema = "origin string, sequence long, record_id string, payload string, payload_hash string"
    for _ in range(2):  # the log comes twice
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "log"))
        replication.replicate(spark, str(tmp_path / "log"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.record_id, r.payload) for r in replication.state(spark, str(tmp_path / "out")).collect()) == [("r", "two"), ("s", "ok")]
    assert sorted(map(tuple, replication.cursors(spark, str(tmp_path / "out")).select("origin", "cursor").collect())) == [("a", 2), ("b", 2), ("c", 2)]
    missing = [("a", i, "r", str(i), sha(str(i))) for i in range(3, 9)] + [rows[-1]]
    spark.createDataFrame(missing, schema).write.mode("append").parquet(str(tmp_path / "log"))
    replication.replicate(spark, str(tmp_path / "log"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.record_id, r.payload) for r in replication.state(spark, str(tmp_path / "out")).collect()) == [("r", "after a gap"), ("s", "ok")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree_of(values, digits):
    """{prefix: (n, hash)} by plain Python."""
    nodes = {}
    for v in sorted(set(values)):
        nodes.setdefault(v[:digits], []).append(v)
    level = {p: (len(v), sha("|".join(v))) for p, v in nodes.items()}
    out = dict(level)
    for d in reversed(range(digits)):
        up = {}
        for p in sorted(level):
            up.setdefault(p[:d], []).append(level[p])
        level = {p: (sum(n for n, _ in c), sha("|".join(h for _, h in c))) for p, c in up.items()}
        out |= level
    return out


def test_hash_tree(spark):
    """Repeats and nulls don't count, partitions don't matter, and two sets differ in the leaves of what one of them lacks."""
    values = [sha(str(i)) for i in range(3000)]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "h string").repartition(5)
    tree = R.hash_tree(frame(values + values[:100] + [None]), 3)
    assert {r.prefix: (r.n, r.hash) for r in tree.collect()} == tree_of(values, 3)
    theirs = [v for v in values if v not in values[10:13]] + [sha("new")]
    changed = {v[:3] for v in [*values[10:13], sha("new")]}
    got = R.differing_leaves(tree, R.hash_tree(frame(theirs), 3), 3).collect()
    assert {r.prefix: (r.ours, r.theirs) for r in got} == {p: (sum(v[:3] == p for v in values), sum(v[:3] == p for v in theirs)) for p in changed}
    assert R.set_root(frame(values)).first().root == tree_of(values, 4)[""][1]
    assert R.set_root(frame(["a", "b", None])).first().root == tree_of([sha("a"), sha("b")], 4)[""][1]
    assert R.set_root(frame([None])).first().root is None and R.hash_tree(frame([None])).count() == 0


def test_truth_root_gathers_nothing(spark):
    from quillstone.plans import reference

    rows = spark.createDataFrame([(1, 0, "user", "The cat is black."), (1, 1, "assistant", "Yes it is.")], "conv_id long, turn int, role string, text string")
    some, none = (reference.agg_statement_root(r) for r in (rows, rows.where("role <> 'user'")))
    assert len(some.first().root) == 64 and none.first().root is None  # as the SQL
    assert "toLocalIterator" not in inspect.getsource(R)  # lists are of a leaf's hashes, or of 16 children
