"""Rules, relations, the truth fold and a project's lists on small tables of their own shape."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.functions import rules as R
from quillstone.operators import lexical as L
from quillstone.operators import patterns as P
from quillstone.operators import projection as J
from quillstone.operators import projects
from quillstone.operators import retrieval as V
from quillstone.operators import truths as U
from quillstone.sources import exports as X

NOW = datetime.datetime(2025, 1, 1)


@pytest.mark.parametrize(("role", "text", "family", "tier"), [
    ("assistant", "We must keep the store", "assistant_or_unknown_author", "RESIDUAL"), ("user", "import os and go on", "code_or_log", "RESIDUAL"), ("user", "Is the store ready?", "question", "RESIDUAL"),
    ("user", "Please summarize the talk", "chat_task", "RESIDUAL"), ("user", "The page is frozen again", "transient_observation", "RESIDUAL"), ("user", "The store is probably Parquet", "speculation", "RESIDUAL"),
    ("user", "Never drop the old store", "explicit_negative_constraint", "D0"), ("Human", "We need Parquet files", "explicit_first_person_requirement", "D0"), ("user", "The backend of all jobs is Parquet", "explicit_project_config", "D1"),
    ("user", "Every truth has to stay small", "bounded_project_requirement", "D1"), ("user", "Keep small files together", "calibrated_short_component_directive", "D2"), ("user", "Keep files", "residual", "RESIDUAL"), ("user", "", "empty_candidate", "RESIDUAL"),
])
def test_strict_families(spark, role, text, family, tier):
    row = spark.createDataFrame([(role, text)], "role string, text string").select(R.strict_rule(F.col("role"), F.col("text"), F.lit("fact")).alias("r")).first().r
    assert (row.family, row.tier) == (family, tier)


SAID = {"conv_id": 1, "text": "The cache uses local files", "subject": "cache store", "value": "local files", "polarity": "NEUTRAL", "scope": None, "keywords": ["cache", "store", "files"]}


@pytest.mark.parametrize(("atom", "truth", "relation"), [
    ({}, {"text": "The cache uses remote rows", "value": "remote rows"}, "CONTRADICTS"), ({"text": "From now on the cache uses local files"}, {"text": "The cache uses remote rows", "value": "remote rows"}, "SUPERSEDES"),
    ({"scope": "tests"}, {"text": "The cache uses the disk", "scope": "jobs"}, "DIFFERENT_SCOPE"), ({"text": "Maybe the cache uses local files"}, {}, "UNCERTAIN"), ({}, {}, "SAME"), ({"conv_id": 2, "text": "The cache uses them"}, {}, "UNCERTAIN"),
    ({"text": "The cache uses local files on the fast disk", "value": "local files on the fast disk"}, {}, "REFINES"), ({"polarity": "NEGATIVE", "text": "No cache of local files"}, {"polarity": "POSITIVE"}, "CONTRADICTS"),
    ({"text": "Other words entirely here", "subject": "another matter", "keywords": []}, {}, "UNCERTAIN"),
])
def test_relations(spark, atom, truth, relation):
    kinds = "conv_id long, text string, subject string, value string, polarity string, scope string, keywords array<string>"
    rows = spark.createDataFrame([(tuple((SAID | atom).values()), tuple((SAID | truth).values()))], f"a struct<{kinds.replace(' long', ':bigint').replace(' string', ':string').replace(' array', ':array')}>, t struct<{kinds.replace(' long', ':bigint').replace(' string', ':string').replace(' array', ':array')}>")
    side = lambda p: {c: F.col(f"{p}.{c}") for c in SAID}
    assert rows.select(R.relation(side("a"), side("t")).alias("r")).first().r == relation


def test_exact_families_need_equal_subjects(spark):
    c = lambda x: F.lit(x)
    got = spark.range(1).select(R.family_compatible(c("explicit_qa_selection"), c("store"), c("explicit_qa_selection"), c("files")).alias("a"), R.family_compatible(c("residual"), c("store"), c("residual"), c("files")).alias("b"), R.family_compatible(c("corroborated_exact_config"), c("Store "), c("residual"), c("store")).alias("c")).first()
    assert (got.a, got.b, got.c) == (False, True, True)


def talk(*said, conv=1):
    return [(conv, i, "user", t) for i, t in enumerate(said)]


def test_fold_in_order(spark):
    rows = talk("The cache store is local files.", "The cache store is remote rows.", "Going forward the cache store is fast disks.", "Going forward the cache store is fast disks.", "Nothing of that sort here.")
    rows += talk("The cache store is local files.", conv=8) + [(1, 9, "assistant", "The cache store is a dream.")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    rows = U.fold_truths(U.atomize(conversations)).collect()
    t, two = {(r.conv_id, r.text): r for r in rows}, sorted(r.status + r.relation for r in rows if "fast disks" in r.text)
    assert t[1, "The cache store is local files."].status in ("CONFLICTING", "SUPERSEDED")
    assert t[1, "The cache store is remote rows."].relation == "CONTRADICTS"
    assert two == ["CURRENTSUPERSEDES", "HISTORICALSAME"]
    assert t[8, "The cache store is local files."].status == "PENDING_REVIEW" and t[8, "The cache store is local files."].relation == "UNCERTAIN"
    assert not any("dream" in x for _, x in t)
    again = sorted((r.truth_id, r.status) for r in U.fold_truths(U.atomize(conversations.repartition(1))).collect())
    assert again == sorted((r.truth_id, r.status) for r in rows)
    assert U.fold_truths(U.atomize(conversations.limit(0))).count() == 0


ATOMS = "atom_id string, project_id string, conv_id long, kind string, text string, subject string, value string, scope string, polarity string, keywords array<string>, confidence double, family string, eligible boolean, truth_status string, created_at timestamp"
TRUTHS = "truth_id string, project_id string, kind string, status string, relation string, atom_id string, evidence_ids array<string>, text string, subject string, value string, scope string, confidence double, updated_at timestamp"
PATTERNS = "pattern_id string, label string, status string, strength double, n long, project_ids array<string>, atom_ids array<string>, updated_at string"


def atom(i, text, kind="fact", project="p1", subject=None, value=None, family="residual", status=None, keywords=None, confidence=0.9):
    words = text.lower().split()
    return (i, project, 1, kind, text, subject or " ".join(words[:3]), value, None, "NEUTRAL", keywords or words[:7], confidence, family, family.startswith(("explicit", "bounded")), status, NOW)


def truth(i, text, status="CURRENT", kind="fact", project="p1", subject=None, value=None, evidence=()):
    return (i, project, kind, status, "NEW", evidence[0] if evidence else None, list(evidence), text, subject or text, value, None, 0.92, NOW)


def shown(spark, atoms=(), truths=(), patterns=()):
    rows = J.lists(J.items(spark.createDataFrame(list(atoms), ATOMS), spark.createDataFrame(list(truths), TRUTHS), spark.createDataFrame(list(patterns), PATTERNS), F.lit(NOW)))
    out = {}
    for r in rows.orderBy("list", "rank").collect():
        out.setdefault((r.project_id, r.list), []).append(r)
    return out


def test_lists_of_an_empty_project(spark):
    assert shown(spark) == {}


def test_truths_decisions_and_what_repeats_them(spark):
    got = shown(
        spark, [atom("a1", "Storage uses columnar files.", subject="storage", value="columnar files", status="CURRENT"), atom("a2", "We decided the importer must keep old rows.", "decision", subject="the importer", value="keep old rows", family="explicit_first_person_requirement"),
                atom("a3", "Please write a long article on storage.", "idea", confidence=0.99), atom("a4", "<div> import export </div> class names only", "idea", confidence=0.99)],
        [truth("t1", "Storage uses columnar files.", subject="storage", value="columnar files", evidence=["a1"])],
    )
    assert [r.statement for r in got["p1", "currentTruth"]] == ["Current truth: Storage is columnar files."]
    assert [(r.statement, r.verification) for r in got["p1", "importantIdeas"]] == [("Decision: The importer is keep old rows.", "DETERMINISTIC_VERIFIED")]


def test_candidates_for_review(spark):
    got = shown(spark, [atom("a1", "Shuffle retry budget limit is 17.", "idea", subject="shuffle retry budget limit", value="17", confidence=0.96)])
    assert [r.verification for r in got["p1", "importantIdeas"]] == ["MRS_PENDING"] and got["p1", "novelty"][0].statement == "Shuffle retry budget limit is 17."
    assert got["p1", "unresolved"][0].source_id == "a1"


def test_changes_questions_and_connections(spark):
    atoms = [atom("a1", "Storage uses plain row files."), atom("a2", "Storage uses columnar block files."), atom("q", "Which part of storage should the tests begin with?", "question"), atom("o", "We decided the other side uses rows.", "decision", "p2", family="explicit_first_person_requirement")]
    truths = [truth("t1", "Storage uses plain row files.", "SUPERSEDED", evidence=["a1"]), truth("t2", "Storage uses columnar block files.", "CONFLICTING", evidence=["a2"]), truth("t3", "Storage could use both file kinds.", "PENDING_REVIEW")]
    patterns = [("x", "Storage and files", "VERIFIED", 0.8, 5, ["p1"], ["q"], ""), ("y", "Elsewhere", "VERIFIED", 0.99, 5, ["p2"], ["o"], ""), ("z", "Weak", "CANDIDATE", 0.1, 9, ["p1"], [], "")]
    got = shown(spark, atoms, truths, patterns)
    assert {r.title for r in got["p1", "changes"]} == {"Superseded state", "Conflict detected", "Unresolved change"}
    assert [r.statement for r in got["p1", "openQuestions"]] == ["Which part of storage should the tests begin with?"]
    assert [(r.statement, r.n_evidence) for r in got["p1", "connections"]] == [("Storage and files", 2)] and [r.statement for r in got["p2", "connections"]] == ["Elsewhere"]


def test_pattern_ladder(spark):
    found = spark.createDataFrame([(k, k, n, 0.4, "OBSERVED", "L2_CANDIDATE", "UNTESTED") for k, n in (("a", 3), ("b", 7), ("c", 3), ("d", 3), ("e", 3))], "pattern_id string, pattern_key string, n long, strength double, status string, maturity string, verification string")
    tests = [("c", "1", "REPLICATION", "PASS", "x"), ("c", "2", "FALSIFICATION", "PASS", "x"), ("c", "3", "TRANSFER", "PASS", "x"), ("c", "4", "TRANSFER", "PASS", "y"), ("d", "1", "COUNTEREXAMPLE", "FAIL", "x"), ("e", "1", "REPLICATION", "PASS", "x"), ("e", "2", "REPLICATION", "PASS", "y")]
    rows = P.evaluated(found, spark.createDataFrame([(*t, None) for t in tests], "pattern_id string, test_id string, kind string, status string, domain string, project_id string"))
    got = {r.pattern_id: (r.status, r.maturity, r.verification, r.falsification) for r in rows.collect()}
    assert got == {
        "a": ("OBSERVED", "L2_CANDIDATE", "UNTESTED", "UNTESTED"), "b": ("TESTING", "L3_HYPOTHESIS", "NEEDS_TRANSFER_TEST", "UNTESTED"), "c": ("VERIFIED", "L6_GENERALIZED", "VERIFIED_EXTERNAL", "SURVIVED"),
        "d": ("TESTING", "L2_CANDIDATE", "COUNTEREXAMPLE_FOUND", "UNTESTED"), "e": ("TESTING", "L5_REPLICATED", "NEEDS_TRANSFER_TEST", "UNTESTED"),
    }


def test_residual_changes(spark):
    cases = [("a b c", "a x c", ("change-replace", "b", "x")), ("a b", "a b c d", ("change-insert", "", "c d")), ("a b c", "c", ("change-delete", "a b", "")), ("a b", "a b", None), ("a b c d e", "v w x y z", None), ("", "a", None), ("a a a", "a a", ("change-delete", "a", ""))]
    rows = spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.r and tuple(r.r) for r in rows.select("i", L.residual(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_near_and_headings(spark):
    rows = spark.createDataFrame([("Chapter one of it",), ("this is a plain line of words that goes on, and on.",), ("ALL CAPS HERE",), ("Ends here.",), ("",)], "t string")
    assert [r.h for r in rows.select(L.heading_like(F.col("t")).alias("h")).collect()] == [True, False, True, False, False]
    seq = F.array(*map(F.lit, "a b c d a e".split()))
    got = spark.range(1).select(L.near(seq, "a", "d", 3).alias("x"), L.near(seq, "b", "e", 2).alias("y"), L.sequence_at(seq, F.array(F.lit("c"), F.lit("d"))).alias("z"), L.occurrences(F.lit("a b a a"), "a").alias("n")).first()
    assert (got.x, got.y, got.z, got.n) == (2.5 + 4.0 * 3 / 4, 0.0, 2, 3)
    q = L.parse('when is "big data" near/3 store')
    assert q.asks == "when" and q.phrases == [["big", "data"]] and L.parse("data NEAR/3 store").near == ("data", "store", 3) and L.parse("changed value of x").wants == "change"


def test_simhash_is_near_for_near_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(1, words), (2, words[:-1] + ["other"]), (3, [f"x{i}" for i in range(60)])], "doc_id long, terms array<string>")
    s = {r.doc_id: r.signature for r in L.simhash(rows, "doc_id", "terms").collect()}
    apart = lambda a, b: bin((s[a] ^ s[b]) & (1 << 64) - 1).count("1")
    assert apart(1, 2) <= 12 < apart(1, 3)


def test_plans_and_search_modes(spark):
    assert V.plan("What did we decide now?").route == "F_TEMPORAL_TRUTH" and V.plan("compare both projects").candidates == 256 and V.plan("plain words").route == "B_250_CHUNK"
    rows = [("truths", "t1", "p1", None, 1, "the store is parquet", "CURRENT", "fact", 0.5, NOW), ("truths", "t2", "p2", None, 1, "the store was rows", "SUPERSEDED", "fact", 0.5, NOW), ("atoms", "a1", "p1", None, 1, "The  store is parquet", None, "fact", 0.5, NOW)]
    records = spark.createDataFrame(rows, "table_name string, record_id string, project_id string, source_id string, conv_id long, text string, status string, kind string, confidence double, updated_at timestamp")
    assert [r.record_id for r in V.search_mode(records, "store", "current").collect()] == ["t1"] and [r.record_id for r in V.search_mode(records, "store", "history").collect()] == ["t2"]
    assert [r.record_id for r in V.retrieve(records, "store parquet", project="p1").collect()] == ["t1"]  # of equal texts the best stays
    assert V.retrieve(records, "store", 24).count() == 2 and V.retrieve(records.limit(0), "store").count() == 0


def test_exports_of_all_shapes(spark, tmp_path):
    (tmp_path / "claude_talks.json").write_text('[{"uuid": "u", "name": "n", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hi"}, {"uuid": "2", "sender": "assistant", "text": " "}, {"uuid": "3", "sender": "bot", "text": "yo"}]}]')
    (tmp_path / "g.json").write_text('{"conversations": [{"id": "g", "messages": [{"id": "1", "role": "model", "parts": [{"text": "a"}, {"text": "b"}]}]}]}')
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("junk.json", '{"settings": [1, 2]}')
        z.writestr("broken.json", '{"a": ')
        z.writestr("conversations.json", '[{"id": "c", "title": "t", "mapping": {"b": {"message": {"id": "m2", "author": {"role": "assistant"}, "content": {"parts": ["two", "lines"]}}}, "a": {"message": {"id": "m1", "author": {"role": "user"}, "content": {"parts": ["one"]}}}, "root": {"message": null}}}]')
        z.writestr("deep.json", '{"provider": "openai", "id": "d", "turns": [{"from": "prompt", "content": {"body": [{"value": 7}, {"value": true}]}}]}')
        z.writestr("note.txt", "no")
    got = sorted((r.provider, r.conversation_id, r.sequence, r.role, r.text) for r in X.normalised(X.read_files(spark, str(tmp_path))).collect())
    assert got == [
        ("chatgpt", "c", 0, "user", "one"), ("chatgpt", "c", 1, "assistant", "two\nlines"), ("chatgpt", "d", 0, "user", "7\ntrue"), ("claude", "u", 0, "user", "hi"), ("claude", "u", 1, "assistant", "yo"), ("gemini", "g", 0, "assistant", "a\nb"),
    ]
    names = spark.createDataFrame([("x/other.json",), ("chat.json",), ("conversations-10.json",), ("conversations.json",), ("conversations-2.json",)], "name string")
    assert [r.name for r in names.orderBy(X.shard_rank(F.col("name"))).collect()] == ["conversations.json", "conversations-2.json", "conversations-10.json", "chat.json", "x/other.json"]


def test_run_history(spark, tmp_path):
    for name, text in (("a", '{"runId": "a", "completedAt": "2024-01-01", "outputPath": "o"}'), ("b", '{"runId": "b", "completedAt": "2024-02-01", "outputPath": "o"}'), ("c", '{"runId": "c"}'), ("d", "{not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    assert [r.runId for r in X.run_history(spark, str(tmp_path)).collect()] == ["b", "a"]


def test_generic_titles_and_matching(spark):
    rows = spark.createDataFrame([("New chat (2024-01-02)",), ("Chat",), ("Storage plans",), (" ",)], "t string")
    assert [r.g for r in rows.select(projects.generic_title(F.col("t")).alias("g")).collect()] == [True, True, False, True]
    prints = spark.createDataFrame([(1, ["parquet", "store", "files", "cache"], []), (2, ["music", "piano"], [])], "conv_id long, content array<string>, names array<string>")
    known = spark.createDataFrame([("p", ["parquet", "store", "files"], [])], "project_id string, terms array<string>, names array<string>")
    got = {r.conv_id: (r.project_id == "p", r.new_name) for r in projects.resolved(prints, known).collect()}
    assert got == {1: (True, None), 2: (False, "Music · Piano")}


def test_snapshots_round_trip(spark, tmp_path):
    from quillstone.sources import snapshots as S

    a = spark.createDataFrame([(1, "x", None), (2, None, 2.5), (2, None, 2.5)], "b int, a string, c double")
    S.write_snapshot({"one": a, "two": a.limit(0)}, str(tmp_path / "s"))
    back = S.read_snapshot(spark, str(tmp_path / "s"), {"one": "a string, b int, c double", "two": "b int", "three": "z int"})
    assert sorted(map(tuple, back["one"].select("b", "a", "c").collect()), key=str) == sorted(map(tuple, a.collect()), key=str) and back["two"].count() == back["three"].count() == 0
    spark.createDataFrame([('{"a":"y","b":9,"c":null}',)], "value string").write.mode("append").text(str(tmp_path / "s/tables/one"))
    with pytest.raises(ValueError, match="one"):
        S.read_snapshot(spark, str(tmp_path / "s"), {"one": "a string"})
    rows = spark.createDataFrame([("",), ("a",), (None,)], "t string").select(S.fnv1a64("t").alias("h"), S.canonical_json(F.lit('{"b": [1, {"d": 1, "c": "é"}], "a": null}')).alias("j")).collect()
    assert [r.h for r in rows] == ["cbf29ce484222325", "af63dc4c8601ec8c", None] and rows[0].j == '{"a":null,"b":[1,{"c":"é","d":1}]}'


def test_change_queries():
    assert L.change_query("changed value red car -> blue car") == ("", "red car", "blue car") and L.change_query("date changed") == ("change-date", "", "") and L.change_query("plain words") is None


def test_next_terms_of_a_long_text(spark):
    """Every run of a text of 20,000 words, in the memory of a test: rows hold a run each, not the text."""
    words = [f"w{i % 700}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = {(r.order, r.context, r.next_term): r.n for r in L.next_terms(docs).where("context = 'w5 w6 w7' or context = 'w699' or context = 'w5'").collect()}
    assert got == {(3, "w5 w6 w7", "w8"): 29, (1, "w699", "w0"): 28, (1, "w5", "w6"): 29}


def test_active_truths_by_term():
    """The truth that a statement meets is that of a scan over all active ones, with exact subjects, ties, equal ids and truths that went."""
    from collections import namedtuple

    import random

    S = namedtuple("S", "truth_id about exact subject_id")
    rng, active, plain = random.Random(8), U._Active(), {}
    for i in range(3000):
        about = [rng.choice("abcdefghijklmnop") if rng.random() < 0.5 else f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 9))]
        a = S(f"t{rng.randrange(2500)}", list(dict.fromkeys(about)), rng.random() < 0.2, f"s{rng.randrange(3)}")
        best, match = 0.0, None
        for t in plain.values():
            like = U._jaccard(frozenset(a.about), frozenset(t.about))
            if like > best and not ((a.exact or t.exact) and a.subject_id != t.subject_id):
                best, match = like, t
        assert active.best(a, 0.25) == (match if best >= 0.25 else None)
        if plain and rng.random() < 0.2:
            gone = rng.choice(list(plain))
            del plain[gone]
            active.drop(gone)
        plain[a.truth_id] = a
        active.put(a)
    assert {w for own in active.by_size.values() for w in own} == {w for t in plain.values() for w in t.about}


def test_providers_of_names(spark):
    names = {"ChatGPT": "chatgpt", "openai": "chatgpt", "Anthropic Claude": "claude", "google": "gemini", "Bard": "gemini", "Microsoft": "copilot", "bing chat": "copilot", "Poe": "poe", "perplexity.ai": "perplexity", "My Own!": "my_own_", "": "generic", " claude ": "claude"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", X.provider(F.col("name")).alias("p"))
    assert {r.name: r.p for r in rows.collect()} == names


def test_project_tabs(spark):
    rows = spark.createDataFrame([("truths", "t1", "a"), ("truths", "t2", "b"), ("truths", "t3", None), ("atoms", "x", "a"), ("patterns", "p", "b"), ("messages", "m", "a"), ("ticks", "k", "a")], "table_name string, record_id string, project_id string")
    ids = lambda tab: {r.record_id for r in V.project_tab(rows, "a", tab).collect()}
    assert (ids("now"), ids("findings"), ids("patterns"), ids("ticks"), ids("evidence"), ids("anything")) == ({"t1"}, {"x"}, {"p"}, {"k"}, set(), {"t1"})
    assert {tuple(r) for r in V.project_tabs(rows).collect()} == {("now", "a", "t1"), ("now", "b", "t2"), ("findings", "a", "x"), ("patterns", None, "p"), ("ticks", "a", "k")}
