"""Plans whose shuffled or broadcast rows outgrew the input."""

from pyspark.sql import functions as F

from quillstone.operators import lexical as L
from quillstone.operators import postings as I
from quillstone.operators import projects as P
from quillstone.plans import catalogue, projection


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_moves_terms_and_no_sums(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "k long, terms array<string>")
    made = plan(L.simhash(rows, "k", "terms"))
    assert "Join" not in made and "REPARTITION_BY_COL" in made  # 64 sums of each row and partition were shuffled


def test_hamming_never_broadcasts_changed_bands(spark):
    rows = spark.createDataFrame([(50, 0), (1, 7), (2, -1)], "doc_id long, signature long")
    found = L.hamming_matches(rows.where("doc_id % 50 = 0"), rows, "doc_id")
    assert "BroadcastHashJoin" not in plan(found)
    assert {(r.asked, r.found, r.distance) for r in found.collect()} == {(50, 50, 0), (50, 1, 3)}


def test_shingles_meet_on_the_rarest_of_an_asked_row(spark):
    texts = [(i, ["common", f"x{i}", f"y{i}"]) for i in range(1, 60)] + [(100, ["common", "x1", "y1", "z"])]
    rows = spark.createDataFrame(texts, "doc_id long, shingles array<string>")
    found = L.shingle_matches(rows.where("doc_id in (1, 100)"), rows, "doc_id")
    assert {(r.asked, r.found, r.similarity) for r in found.collect()} == {(1, 100, 0.75), (100, 1, 0.75)}
    assert "array_intersect" in plan(found)  # all pairs of the common shingle were counted


def test_contexts_are_dealt_once_a_level(spark):
    docs = spark.createDataFrame([(1, "a b c d e a b c x"), (2, "b")], "doc_id long, text string")
    found = L.next_terms(docs)
    assert plan(found).count("keys=[order") == 0  # each order was shuffled by its term, then again by its context
    want = {(2, "a b", "c", 2, 1), (3, "a b c", "d", 1, 1), (3, "a b c", "x", 1, 2), (0, "", "b", 3, 1), (1, "b", "c", 2, 1)}
    assert want <= {tuple(r) for r in found.select("order", "context", "next_term", "n", "rank").collect()}


def test_guesses_travel_no_further_than_their_join(spark):
    rows = L.ngram_contexts(spark.createDataFrame([(1, "a b c. a b d.")], "doc_id long, text string"))
    found = L.predictions(rows, L.predictor(rows))
    assert {(r.term, r.order) for r in found.where("place = 0 or order is null").collect()} == set()
    assert found.agg(F.sum("n")).first()[0] == rows.count()
    assert "g3" not in plan(found)


def test_units_are_made_once(spark):
    """Each was made twice and its normal form up to five times: by the two sides of a join, or by a filter that went below the units."""
    docs = spark.createDataFrame([(1, "One thing. " * 40), (2, "other words"), (3, "Other  words!"), (4, None)], "doc_id long, text string")
    rows = L.units(L.sections(L.paragraphs(docs)))
    once, twice = L.unique_units(rows), L.duplicates(rows, L.family_key(F.col("norm")))
    assert "Join" not in plan(once) and {r.doc_id for r in once.collect()} == set()
    assert "Filter" not in plan(twice).split("Generate explode(filter")[1].split("Generate posexplode")[0]
    assert ("other words|other words|0", 2, 2) in {(r.key, r.n, r.first_doc) for r in twice.collect()}


def test_long_texts_are_no_headings_and_their_words_not_counted(spark):
    texts = ["Part " + "x " * 400, "Part one", "word " * 30 + "one. Two.", "w " * 18 + "x" * 400 + ". y", "a. b. " * 3 + "x" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.heading_like(F.col("t")).alias("h"), L.stays_whole(F.col("t"), F.lit(False)).alias("w"))
    assert [(r.h, r.w) for r in rows.orderBy("i").collect()] == [(False, True), (True, True), (False, True), (False, True), (False, True)]


def test_projects_are_met_without_pairs(spark):
    """Each pair of a conversation and a project with a word in common was a row, joined twice."""
    prints = [(i, ["common", *(f"w{i % 7}{j}" for j in range(i % 15))], [f"n{i % 5}"] if i % 3 else []) for i in range(60)] + [(60, [], [])]
    rows = spark.createDataFrame(prints, "conv_id long, content array<string>, names array<string>")
    projects = rows.where("conv_id % 10 = 0").select(F.concat(F.lit("p"), "conv_id").alias("project_id"), F.slice("content", 1, 12).alias("terms"), F.slice("names", 1, 8).alias("names"))
    found = P.matched(P.project_scores(rows, projects, 3, 2))
    assert "Join" not in plan(P.project_scores(rows, projects))
    want = {}
    for c, content, names in prints:
        scored = []
        for p, words, named in prints[::10]:
            terms, pn = set(words[:12]), set(named[:8])
            if {*content, *names} & {*terms, *pn}:
                like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
                over = len(set(content[:12]) & terms) / len(set(content[:12])) if content and terms else 0.0
                score = round(0.46 * max(like(set(content[:20]), terms), over) + 0.18 * like(set(names), pn) + 0.12 * bool({*content, *names} & pn), 9)
                scored.append((-score, f"p{p}", len(set(content) & terms)))
        if scored:
            (s, p, shared), *rest = sorted(scored)
            want[c] = (p, -s, -s >= 0.14 and shared >= 3 and (not rest or -s >= -rest[0][0] + 0.08))
    assert {r.conv_id: (r.project_id, r.score, r.accepted) for r in found.collect()} == want


def test_postings_shuffle_texts_and_no_words(spark):
    """Each word of a record was a row that was shuffled by record and term."""
    texts = [(1, "One two, one THREE naïve K2x a-b"), (1, "two é"), (2, None), (3, ""), (4, "ab c"), (None, "lost words"), (5, "x" * 9_000_000 + " tail")]
    rows = I.postings(spark.createDataFrame(texts, "record_id long, text string"))
    assert "hashpartitioning(record_id" in plan(rows) and not [line for line in plan(rows).splitlines() if "Exchange" in line and "term" in line]
    got = {(r.record_id, r.term if len(r.term) < 99 else len(r.term), r.n) for r in rows.collect()}
    assert got == {(1, "one", 2), (1, "two", 2), (1, "three", 1), (1, "k2x", 1), (5, 9_000_000, 1), (5, "tail", 1)}


def test_a_job_finds_its_evidence_once(spark):
    """Its bundle, sufficiency and ids each found it anew, and statements were made for themselves and for truths: six times in all."""
    made = plan(catalogue.QUERIES["q_job"](spark, "/root/testdata/sf0.001"))
    assert made.count("Generate posexplode") == 1


def test_items_make_statements_once(spark):
    """Each kind of item made all statements and truths from the conversations again."""
    made = plan(projection._items(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    assert "conversations.parquet" not in made


def test_before_looks_beyond_a_conversation(spark):
    """Statements of a project were sorted in one task to find the one before each."""
    rows = spark.createDataFrame([("p1", 1, 0, 0, "a"), ("p1", 1, 0, 1, "b"), ("p1", 1, 2, 0, "c"), ("p1", 8, 1, 0, "d"), ("p1", 15, 0, 0, "e"), ("p2", 2, 0, 0, "f")], "project_id string, conv_id long, sequence int, index int, atom_id string")
    assert {r.atom_id: r.before for r in projection.placed_after(rows).collect()} == {"a": None, "b": "a", "c": "b", "d": "c", "e": "d", "f": None}


def test_a_search_makes_units_once(spark):
    """All units were made to count the query's terms and made again to be scored, those of texts without a term as well."""
    texts = ["No hit here.", "Thing one. " * 30, "A.thing\n\nnothing", "things nothing éthing", "THING-x", None, "thing2 2thing thing_"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    paras = L.sections(L.paragraphs(docs))
    found = L.search(L.units(paras), "thing other", 50)
    assert "posexplode" not in plan(found)
    assert {r.doc_id for r in found.collect()} == {1, 2, 3, 4, 6}
    can = L.may_match(F.col("text"), "thing other")
    assert {(r.doc_id, r.paragraph) for r in paras.where(can).collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (6, 0)}
    assert L.search(L.units(paras.where(can)), "thing other", 50).collect() == found.collect()
    for query in ("section contains one thing", "heading: thing", "..."):  # these leave units without a term
        assert paras.where(L.may_match(F.col("text"), query)).count() == paras.count()
