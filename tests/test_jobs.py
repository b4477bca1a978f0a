"""Jobs made of a question's evidence, and answers held against them."""

import datetime

import pytest

from quillstone.operators import retrieval as V

NOW = datetime.datetime(2025, 1, 1)
RECORD = "table_name string, record_id string, project_id string, source_id string, conv_id long, text string, status string, kind string, confidence double, updated_at timestamp"
ROWS = [
    ("truths", "t1", "p1", None, 1, "The cache store is local files", "CURRENT", "fact", 0.9, NOW), ("truths", "t2", "p1", None, 1, "The cache store is remote rows", "CONFLICTING", "fact", 0.8, NOW),
    ("atoms", "a1", None, None, 1, "A cache of rows", None, "decision", 0.7, NOW), ("messages", "m1", "p2", "user", 2, "Where is the cache store?", None, None, None, NOW), ("atoms", "a2", None, None, 1, None, None, None, None, NOW),
]


def test_job(spark):
    rows = spark.createDataFrame(ROWS, RECORD)
    make = lambda r, created="1", project=None: V.job(V.retrieve(r, "cache store", project=project), "cache store", "root", created, project)
    job = make(rows).first()
    assert make(rows.repartition(3)).first() == job
    assert job.record_ids[0] == "t1" and set(job.record_ids) == {"t1", "t2", "a1", "m1"} and job.n_evidence == len(job.evidence_ids) == 4
    assert job.route == "B_250_CHUNK" and job.used_fallback == (job.sufficiency_state != "SUFFICIENT") and job.fallback == ("B_250_CHUNK" if job.used_fallback else None)
    later, fewer, own = make(rows, "2").first(), make(rows.where("record_id <> 'a1'")).first(), make(rows, project="p1").first()
    assert len({j.job_id for j in (job, later, fewer, own)}) == len({j.hash for j in (job, later, fewer, own)}) == 4
    assert later.evidence_hash == job.evidence_hash != fewer.evidence_hash and "m1" not in own.record_ids
    none = make(rows.limit(0)).first()
    assert (none.evidence_ids, none.n_evidence, none.used_fallback) == ([], 0, True)
    with pytest.raises(ValueError, match="question"):
        V.job(rows, " ", "root", "1")


def test_answers(spark):
    jobs = spark.createDataFrame([("j", ["e1", "e2"]), ("k", [])], "job_id string, evidence_ids array<string>")
    cited = [("good", "j", "e1"), ("good", "j", "e1"), ("good", "j", "e2"), ("bad", "j", "e3"), ("bad", "j", "e1"), ("none", "j", None), ("lost", "x", "e1"), ("empty", "k", "e1")]
    got = V.job_answers(jobs, spark.createDataFrame(cited, "answer_id string, job_id string, evidence_id string")).collect()
    assert {r.answer_id: (r.n_cited, r.n_outside, r.status) for r in got} == {"good": (2, 0, "PASS"), "bad": (2, 1, "FAIL"), "none": (0, 0, "FAIL"), "lost": (1, 1, "FAIL"), "empty": (1, 1, "FAIL")}
