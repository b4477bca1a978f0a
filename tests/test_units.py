"""Units of paragraphs against a reading sign by sign."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import lexical as L

from .split_brute import units

BITS = ["e.g.", "i.e. ", "Mr. ", "Prof. ", "etc.", "No. ", "U.S. ", "3.14 ", " 3. ", "10.0.0.1 ", "end. ", "sentence. ", "longword! ", "what?! ", '"Quoted." ', "(in brackets.) ", " \x01 ", " \x01\x03 ", "é中 ", "ab..c ", "....", "a.b. ", "abcdefghi. ", "a.bcdefghij. ", "\n", " \n\n ", "some more words here ", "final words of a longer sentence with many terms in it. ", "12.", "x. ", "..a. ", ".a.b."]


def test_against_each_sign(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 80))).strip() for _ in range(600)]
    texts += ["Ha! " * 3000, "1." * 5000 + "a b c " * 20 + ". x! y?", "word " * 20000 + ". z? w!", "A sentence of many words, which is long enough to be left alone here. " * 400]
    rows = spark.createDataFrame([(i, t, i % 17 == 0) for i, t in enumerate(texts)], "i int, t string, h boolean").repartition(4)
    for r in rows.select("i", L.split_atoms(F.col("t"), F.col("h")).alias("u")).collect():
        data = texts[r.i].encode()
        want = units(texts[r.i], r.i % 17 == 0)
        assert [(u.start, u.stop) for u in r.u] == want
        assert [u.text.encode() for u in r.u] == [data[a:b] for a, b in want]


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("short", 1)])
def test_edges(spark, text, n):
    got = spark.createDataFrame([(text,)], "t string").select(F.size(L.split_atoms(F.col("t"), F.lit(False))).alias("n")).collect()[0].n
    assert got == n


def test_what_shortened_words_do(spark):
    """Full stops of `Dr.`, `e.g.` and `3.5` end nothing; two sentences that are long enough stay apart."""
    one = "The visit of Dr. Smith to the U.S. took 3.5 weeks, e.g. in spring, and was described in a very long letter to the board."
    two = "Nobody on the committee had expected that the second report, which came later, would contradict everything."
    rows = spark.createDataFrame([(f"{one} {two}", False)], "t string, h boolean")
    got = rows.select(F.explode(L.split_atoms(F.col("t"), F.col("h"))).alias("u")).select("u.*").collect()
    assert [r.text for r in got] == [one, two] and got[1].start == len(one) + 1


def test_predictor_backs_off(spark):
    """The longest context that the table knows decides, islands start anew, and texts of end signs, nulls and empty ones do no harm."""
    say = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")
    table = L.predictor(L.ngram_contexts(say("the cat sat on. the cat sat on! the dog ran", None, "", "?.\n", "a cat slept")), k=2)
    got = {(r.order, r.context): r.guesses for r in table.collect()}
    assert got[3, "<s> <s> <s>"][0] == "the"
    assert got[3, "<s> the cat"] == ["sat"] and got[2, "the cat"] == ["sat"] and got[1, "cat"] == ["sat", "slept"] and len(got[0, ""]) == 2
    asked = L.ngram_contexts(say("the cat sat", "big cat slept", "zzz yyy"))
    found = {(r.p3, r.p2, r.p1, r.term): (r.order, r.place) for r in L.predictions(asked, table).collect()}
    assert found["<s>", "the", "cat", "sat"] == (3, 1) and found["<s>", "big", "cat", "slept"] == (1, 2) and found["<s>", "<s>", "zzz", "yyy"] == (0, 0)
    assert {r.order for r in L.predictions(asked, table.where("false")).collect()} == {None}


def test_what_a_query_is():
    """Titles by quotes, marks, single words and capitals; questions by their word or mark; filters are taken out of the text."""
    intents = {"what is love": "question", "love?": "question", "Love": "title", "love": "title", "Deep Space Nine": "title", "deep space nine": "concept", '"deep space"': "title", "a - b c d e": "title", "what is \"love\"": "title", "Deep space": "concept", "one two three four": "concept"}
    assert {q: L.parse(q).intent for q in intents} == intents
    got = [(q.text, q.section, q.heading) for q in map(L.parse, ('find stars section contains "black holes" now', "heading: the end of time", "stars section:'a b'", "SECTION CONTAINS x"))]
    assert got == [("find stars  now", "black holes", ""), ("", "", "the end of time"), ("stars", "a b", ""), ("", "x", "")]
    assert L.parse("when did 2024-03-05 or March 7, 2023 cost $1,200 in the U.S.").asks == "when"
    assert L._signed_query(L.dates, "2024-3-5 or March 7, 2023") == ["2023-03-07", "2024-03-05"]
    assert L._signed_query(L.abbreviations, "the U.S. and e.g. this") == ["e.g", "u.s"] and L._signed_query(L.numbers, "$1,200 or 5%") == ["1200", "5%"]


@pytest.fixture(scope="module")
def searched(spark):
    docs = [
        (1, "The station was built on 2024-03-05 by a crew of workers from the coast who came by ship."),
        (2, "The station was built on 2020-01-01 by a crew of workers from the coast who came by ship."),
        (3, "The station was built long ago by a crew of workers from the coast who came by ship then."),
        (4, "The pump cost $1,200 when it was bought for the station and 5% more after a year had gone by."),
        (5, "The pump cost a lot when it was bought for the station and even more after a year had gone by."),
        (6, "Water Stations\n\nThe pump of a water station is what moves the water, and the crew repairs it every spring."),
        (7, "pump station\nof the\nNorth coast"),
        (8, "The U.S. station was e.g. built by a crew of workers from the other coast who came by ship."),
        (9, "The S station was built by a crew of workers from the other U coast who came by great ship."),
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return L.units(L.sections(L.paragraphs(rows))).cache()


def found(rows, query, n=20):
    return {(r.doc_id, r.paragraph): r for r in L.search(rows, query, n).collect()}


def test_dates_numbers_and_abbreviations_score(searched):
    """A date asked for adds 7.5, 4 if all are there, and 2 and 1.8 to a `when`; without it 3.5 and perhaps .8 go. The other terms of these texts add the same."""
    got = found(searched, "station built on 2024-03-05 crew")
    extra = got[1, 0].score - got[2, 0].score
    assert got[1, 0].calibrated > got[2, 0].calibrated and extra > 7.5 + 4
    when = found(searched, "when was the station built: 2024-03-05")
    assert max(when.values(), key=lambda r: r.score).doc_id == 1
    assert (2, 0) not in when and when[1, 0].score > 7.5 + 4 + 2 + 1.8
    cost = found(searched, "pump cost $1,200 station")
    assert cost[4, 0].score - cost[5, 0].score > 4.5 + 2 + 0.4 + 0.6
    short = found(searched, "station of the U.S. coast")
    assert short[8, 0].score - short[9, 0].score > 4.5 + 2 + 0.4 + 1.8 - 1


def test_filters_and_shapes(searched):
    """Headings and sections by name; a filter alone ranks all that it leaves; lines like a cover go down for questions, up to the shortlist's three."""
    assert set(found(searched, "section contains water")) == {(6, 0), (6, 1)}
    own = found(searched, "section: 'water station'")
    assert own[6, 0].score > own[6, 1].score and own[6, 0].reason == "filter"
    assert [(r.doc_id, r.paragraph) for r in L.structural(searched, L.parse("heading contains 'pump north'")).collect()] == [(7, 0)]
    assert set(found(searched, "heading contains water")) == {(6, 0), (6, 1)}
    got = found(searched, "what does a pump of a station do")
    assert (7, 0) not in got or got[7, 0].score < got[6, 1].score - 5
    three = L.search(searched, "pump station", 3).collect()
    assert [(r.doc_id, r.paragraph) for r in three] == [(r.doc_id, r.paragraph) for r in L.search(searched, "pump station", 20).collect()[:3]]
    assert all(r.matched == 0 and r.reason == "shape" for r in found(searched, "...").values())  # without terms all units are ranked by their shape
