"""Text as paragraphs, sections and units; ranked search, likeness and change between units.

A unit is a sentence of a paragraph, known by doc_id, paragraph and unit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import folders
from . import contexts as runs_of
from .sections import section_changes, shared_terms

PARAGRAPH_BREAK = r"\n[ \t\r]*(?:\n[ \t\r]*)*\n"
# What starts a heading, and the cues of answers to a question word with what they add.
HEADING_STARTS = ("chapter ", "section ", "part ", "page ", "introduction", "preface", "conclusion")
CUES = {
    "what": (((" is ", " are ", " means ", " refers to ", " described by "), 1.8),),
    "how": (
        ((" form ", " forms ", " formed ", " forming "), 3.5), ((" collapse ", " collapsed ", " collapsing "), 3.0), ((" cause ", " caused ", " causes ", " because ", " due to "), 2.6),
        ((" using ", " by ", " through "), 1.8), ((" studied ", " study ", " observing ", " observed "), -0.9),
    ),
    "where": (((" found ", " located ", " center ", " centers ", " at the ", " in the "), 1.8),),
    "why": (((" because ", " due to ", " since ", " so "), 1.8),),
    "when": (((" when ", " after ", " before "), 1.4),),
    "who": (((" scientists ", " people ", " researchers "), 1.0),),
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
LOWER_WORD = r"(^|[^A-Za-z0-9])([a-z][A-Za-z0-9]*|[0-9][A-Z0-9]*[a-z][A-Za-z0-9]*)"
TITLE_WORD = r"(^|[^A-Za-z0-9])([A-Z]|[0-9][A-Z0-9]*[A-Z][A-Z0-9]*([^A-Za-z0-9]|$))"
ISO_DATE = r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"
LONG_DATE = r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{1,2},? [0-9]{4}"
NUMERIC = r"\$?[0-9]+(?:[.,][0-9]+)*[A-Za-z]*%?"
ABBREVIATION = r"(?:[A-Za-z]\.){2,}"
# Bytes and terms under which a range is short, bytes up to which ranges are merged, and what keeps a paragraph whole.
SHORT_BYTES, SHORT_TERMS, MERGED_BYTES = 48, 6, 220
WHOLE_BYTES, WHOLE_TERMS, LINED_BYTES = 220, 18, 320
#: Words of letters and full stops that end in one, ten signs at most: two stops or more (`e.g.`), or four letters at most (`Prof.`).
SHORTENED = r"(?<!\S)(?:(?=\.*[A-Za-z]\.*[A-Za-z])(?=[A-Za-z]*\.[A-Za-z]*\.)[A-Za-z.]{2,9}\.|[A-Za-z]{2,4}\.)(?!\S)"
_ESC, _CUT, _OPEN, _SHUT = "\x01", "\x01\x03", "\x01\x04", "\x01\x05"  # in a text, \x01 is written \x01\x02 meanwhile
_END = rf"(?:[!?]|(?<![0-9])(?<!{_OPEN}[A-Za-z.]{{0,9}})\.|(?<=[0-9])\.(?![0-9]))"


def title_cased(t: Column) -> Column:
    return t.rlike(TITLE_WORD) & ~t.rlike(LOWER_WORD)


def heading_like(text: Column) -> Column:
    """Short, without an end mark, and in title case, capitals, very short or begun like a heading."""
    t = F.trim(text)
    n = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    fits = (n > 0) & (n <= 14) & (breaks <= 2) & ~t.rlike(r"[.!?:;]\z") & t.rlike("[A-Za-z]")
    named = F.lit(False)
    for start in HEADING_STARTS:
        named = named | F.lower(t).startswith(start)
    shaped = fits & (((n <= 8) & (title_cased(t) | ~t.rlike("[a-z]"))) | ((n <= 4) & (F.octet_length(t) <= 50)) | ((n <= 6) & named))
    return F.when(F.octet_length(t) <= 140, shaped).otherwise(t.isNull() & F.lit(None))  # words of long texts are not counted


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, text and is_heading of the runs of lines between blank ones."""
    each = docs.where("text is not null").select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", PARAGRAPH_BREAK), lambda p: F.trim(p)), lambda p: p.rlike(T.NOT_WS))).alias("paragraph", "text"))
    return each.withColumn("is_heading", heading_like(F.col("text")))


def sections(paras: DataFrame) -> DataFrame:
    """Paragraphs with section, counted from 0, and heading: a section starts at a heading; the first paragraph starts one anyway."""
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    rows = paras.withColumn("section", F.sum((F.col("is_heading") & (F.col("paragraph") > 0)).cast("int")).over(w))
    own = Window.partitionBy("doc_id", "section").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("heading", F.first(F.when(F.col("is_heading"), F.col("text")).otherwise("")).over(own))


def section_spans(paras: DataFrame) -> DataFrame:
    return sections(paras).groupBy("doc_id", "section").agg(F.min("paragraph").alias("first_paragraph"), F.max("paragraph").alias("last_paragraph"), F.first("heading").alias("heading"))


def native_terms(c: Column) -> Column:
    """ASCII runs of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(T.lower_ascii(c), F.lit("[a-z0-9]+"), 0)


def _marked(text: Column) -> Column:
    """A text whose \\x01 are escaped and whose shortened words stand between marks."""
    return F.regexp_replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "\x02")), SHORTENED, f"{_OPEN}$0{_SHUT}")


def sentence_marks(text: Column) -> Column:
    """How many of a text's . ! ? end a sentence: not those in numbers and shortened words."""
    return F.regexp_count(_marked(text), F.lit(_END))


def term_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9A-Za-z]+"))


def _few_terms(text: Column, most: int) -> Column:
    """Whether a text has `most` terms or fewer; of a longer one only the start is read."""
    return ~text.rlike(rf"\A[^0-9A-Za-z]*+(?:[0-9A-Za-z]++[^0-9A-Za-z]++){{{most}}}[0-9A-Za-z]")


def _some_terms(text: Column) -> Column:
    """How many terms a text has, counted to SHORT_TERMS and no further."""
    return F.least(F.size(F.filter(F.split(text, "[^0-9A-Za-z]+", SHORT_TERMS + 2), lambda x: x != "")), F.lit(SHORT_TERMS))


def ranges(text: Column) -> Column:
    """array<struct<start, stop, terms>>: byte ranges of a text's sentences, with closing quotes and brackets, without the white space behind; terms are counted to SHORT_TERMS."""
    return T.once(_marked(text), _ranges)


def _ranges(marked: Column) -> Column:
    cut = F.split(F.regexp_replace(marked, _END + r"""["')\]}]*\s*""", f"$0{_CUT}"), _CUT)
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit(_OPEN), F.lit("")), F.lit(_SHUT), F.lit("")), F.lit(_ESC + "\x02"), F.lit(_ESC))
    pieces = F.transform(cut, lambda x: F.when(x.contains(_ESC), plain(x)).otherwise(x))

    def placed(q):
        ends = F.aggregate(q, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(x))))
        each = T.once(ends, lambda e: F.transform(q, lambda x, i: F.struct(F.get(e, i).alias("start"), (F.get(e, i) + F.octet_length(F.rtrim(x, F.lit(" \t\n\x0b\f\r")))).alias("stop"), _some_terms(x).alias("terms"))))
        return F.filter(each, lambda r: r["stop"] > r["start"])

    return T.once(pieces, placed)


def merged(found: Column) -> Column:
    """Ranges joined from the first on: one that is short, or meets a short one, takes in the next, up to 220 bytes of both."""
    size = lambda r: r["stop"] - r["start"]
    short = lambda r: (size(r) < SHORT_BYTES) | (r["terms"] < SHORT_TERMS)
    kind = "struct<start:int,stop:int,terms:int>"
    state = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def step(acc, r):
        now = acc["now"]
        joins = (size(now) + size(r) <= MERGED_BYTES) & (short(now) | short(r))
        both = F.struct(now["start"].alias("start"), r["stop"].alias("stop"), (now["terms"] + r["terms"]).alias("terms"))
        return F.when(now.isNull(), F.struct(acc["done"].alias("done"), r.alias("now"))).when(joins, F.struct(acc["done"].alias("done"), both.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(now)).alias("done"), r.alias("now")))

    return F.aggregate(found.cast(f"array<{kind}>"), state, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def _small(text: Column, is_heading: Column) -> Column:
    """Headings, short paragraphs and lists of short lines."""
    size = F.octet_length(text)
    lined = F.when(size <= LINED_BYTES, F.regexp_count(text, F.lit("\n")) >= 2).otherwise(F.lit(False))
    return F.when(is_heading | (size <= WHOLE_BYTES), True).otherwise(lined | _few_terms(text, WHOLE_TERMS))


def _one_sentence(marked: Column) -> Column:
    return F.size(F.split(marked, _END, 3)) <= 2  # the search ends at the second mark


def stays_whole(text: Column, is_heading: Column) -> Column:
    """Headings, short paragraphs, lists of short lines and paragraphs with one sentence at most."""
    return F.when(_small(text, is_heading), True).otherwise(_one_sentence(_marked(text)))


def split_atoms(text: Column, is_heading: Column) -> Column:
    """array<struct<start, stop, text>>: a paragraph's units and their byte offsets in it.

    Paragraphs that don't stay whole are cut at sentence ends, and short sentences merged. The cost of a merge grows with the number of a paragraph's units, not with other paragraphs. Null and empty texts have none.
    """
    n = F.octet_length(text)
    one = F.array(F.struct(F.lit(0).alias("start"), n.alias("stop"), text.alias("text")))
    kind = "array<struct<start:int,stop:int,text:string>>"

    def cut(marked):
        data = lambda d: F.transform(merged(_ranges(marked)), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), F.substring(d, r["start"] + 1, r["stop"] - r["start"]).cast("string").alias("text")))
        return F.when(_one_sentence(marked), one).otherwise(T.once(text.cast("binary"), data))

    return F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast(kind)).when(_small(text, is_heading), one.cast(kind)).otherwise(T.once(_marked(text), cut).cast(kind))


def words_of(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda x: x != "")


def units(paras: DataFrame) -> DataFrame:
    """Units of paragraphs with their byte offsets and what search needs of them."""
    kept = [c for c in ("section", "heading") if c in paras.columns]
    found = T.once(split_atoms(F.col("text"), F.col("is_heading")), lambda q: F.transform(q, lambda u: F.struct(u["start"].alias("start"), u["stop"].alias("stop"), u["text"].alias("text"), (F.size(q) == 1).alias("alone"))))
    each = paras.select("doc_id", "paragraph", *kept, "is_heading", F.posexplode(found).alias("unit", "u")).select("doc_id", "paragraph", *kept, "is_heading", "unit", "u.*")
    each = each.withColumn("norm", T.normalize_search(F.col("text"))).withColumn("seq", words_of(F.col("norm")))
    n, bytes_ = F.size(F.array_distinct("seq")), F.octet_length("text")
    marks, breaks = F.regexp_count("text", F.lit("[.!?]")), F.regexp_count("text", F.lit("\n"))
    return each.withColumns({
        "terms": F.array_sort(F.array_distinct("seq")), "n_terms": n, "title_like": (n <= 18) & (bytes_ <= 220) & (breaks <= 3) & (marks <= 1),
        "cover_like": (n <= 30) & (bytes_ <= 260) & (breaks >= 2) & (marks <= 2),
    })


def cue(text: Column, word: str, i: int = 0) -> Column:
    low, out = T.lower_ascii(text), F.lit(False)
    for needle in CUES[word][i][0]:
        out = out | low.contains(needle)
    return out


def leading(norm: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(F.split(norm, " "), 1, n), " ")


def trailing(norm: Column, n: int = 6) -> Column:
    words = F.split(norm, " ")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")


def family_key(norm: Column) -> Column:
    return F.when(norm == "", "").otherwise(F.concat_ws("|", leading(norm), trailing(norm), F.floor(F.length(norm) / 24).cast("string")))


def fingerprint(norm: Column, n_terms: Column) -> Column:
    return F.sha2(F.concat_ws("|", leading(norm), trailing(norm), n_terms.cast("string"), F.floor(F.length(norm) / 16).cast("string")).cast("binary"), 256)


def shingles(seq: Column, norm: Column) -> Column:
    """Distinct runs of three terms, sorted; of shorter texts the whole."""

    def of(q):
        runs = F.transform(F.sequence(F.lit(1), F.size(q) - 2), lambda i: F.array_join(F.slice(q, i, 3), "|"))
        return F.when(F.size(q) >= 3, F.array_sort(F.array_distinct(runs))).when(norm != "", F.array(norm)).otherwise(F.array().cast("array<string>"))

    return T.once(seq, of)


def dates(text: Column) -> Column:
    """Dates as YYYY-MM-DD, sorted and distinct."""
    pad = lambda c: F.lpad(c, 2, "0")
    iso = F.transform(F.regexp_extract_all(text, F.lit(ISO_DATE), 0), lambda d: F.concat_ws("-", F.split(d, "[-/.]")[0], pad(F.split(d, "[-/.]")[1]), pad(F.split(d, "[-/.]")[2])))
    month = lambda d: F.floor((F.instr(F.lit(MONTHS), F.lower(F.substring(d, 1, 3))) + 2) / 3).cast("string")
    long = F.transform(F.regexp_extract_all(text, F.lit(LONG_DATE), 0), lambda d: F.concat_ws("-", F.element_at(F.split(d, " "), 3), pad(month(d)), pad(F.replace(F.element_at(F.split(d, " "), 2), F.lit(","), F.lit("")))))
    return F.array_sort(F.array_distinct(F.concat(iso, long)))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), 0), lambda x: F.lower(F.regexp_replace(x, "[$,]", "")))))


def abbreviations(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ABBREVIATION), 0), lambda x: F.lower(F.regexp_replace(x, r"\.$", "")))))


def occurrences(norm: Column, word: str) -> Column:
    """How often a word or run of words stands in normalised text, as whole words."""
    marked = F.concat(F.lit("  "), F.replace(norm, F.lit(" "), F.lit("  ")), F.lit("  "))  # a blank of its own on either side of each word
    return F.regexp_count(marked, F.lit(" " + re.escape(word).replace(r"\ ", "  ") + " "))


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)


def sequence_at(seq: Column, words: Column) -> Column:
    """Place, from 0, of a run of words among others; -1 where it isn't."""
    line = F.concat(F.lit(" "), F.array_join(seq, " "), F.lit(" "))
    at = F.instr(line, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    return F.when((F.size(words) == 0) | (at == 0), -1).otherwise(F.size(F.split(F.substring(line, 1, 1 << 30).substr(F.lit(1), at), " ")) - 2)


def near(seq: Column, left: str, right: str, distance: int) -> Column:
    """2.5 and up to 4 more the nearer two words stand; 0 beyond the distance."""

    def gap_of(p):  # the nearest two are neighbours among the places of both
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.array_min(F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.when(a["first"] != b["first"], b["at"] - a["at"])))

    def of(q):
        if left == right:
            return F.when(F.array_contains(q, left), 0)
        places = F.transform(q, lambda x, i: F.when(x.isin(left, right), F.struct(i.alias("at"), (x == left).alias("first"))))
        return T.once(F.filter(places, lambda x: x.isNotNull()), gap_of)

    return T.once(of(seq), lambda gap: F.when(gap <= distance, 2.5 + 4.0 * (distance - gap + 1) / (distance + 1)).otherwise(0.0))


def first_distinct(a: Column, b: Column) -> Column:
    """The first of a that isn't in b, else the first of a, else nothing."""
    return F.coalesce(F.try_element_at(F.filter(a, lambda x: ~F.array_contains(b, x)), F.lit(1)), F.try_element_at(a, F.lit(1)), F.lit(""))


def residual(a: Column, b: Column) -> Column:
    """struct(kind, gone, come) of two term sequences: what differs between their common start and end, up to three words replaced."""
    none = F.lit(None).cast("struct<kind:string,gone:string,come:string>")

    def common(x, y, most):  # how many elements two arrays have in common from the start, up to `most`
        differ = lambda i: F.when(F.get(x, i) != F.get(y, i), i)
        return F.coalesce(F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), differ)), most)

    def parts(z):
        p, q, prefix, suffix = z["a"], z["b"], z["prefix"], z["suffix"]
        la, lb = F.size(p) - prefix - suffix, F.size(q) - prefix - suffix
        mid = lambda x, m: F.array_join(F.slice(x, prefix + 1, F.greatest(m, F.lit(0))), " ")
        made = lambda kind: F.struct(F.lit(kind).alias("kind"), mid(p, la).alias("gone"), mid(q, lb).alias("come"))
        return F.when((la == 0) & (lb > 0), made("change-insert")).when((lb == 0) & (la > 0), made("change-delete")).when((la > 0) & (lb > 0) & (la <= 3) & (lb <= 3), made("change-replace")).otherwise(none)

    def ends(z):
        rest = F.least(F.size(z["a"]), F.size(z["b"])) - z["prefix"]
        suffix = F.when(rest > 0, common(F.reverse(z["a"]), F.reverse(z["b"]), rest)).otherwise(0)
        return T.once(F.struct(z["a"].alias("a"), z["b"].alias("b"), z["prefix"].alias("prefix"), suffix.alias("suffix")), parts)

    def starts(z):
        n = F.least(F.size(z["a"]), F.size(z["b"]))
        return F.when(n > 0, T.once(F.struct(z["a"].alias("a"), z["b"].alias("b"), common(z["a"], z["b"], n).alias("prefix")), ends)).otherwise(none)

    return T.once(F.struct(a.alias("a"), b.alias("b")), starts)


def _similarity() -> Column:
    return F.round(F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")), 9)


def like_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of units of one section that share at least `least` of all their terms, the earlier one first, with similarity."""
    pairs = shared_terms(rows, lambda n1, n2, of, left, right: least, []).withColumn("similarity", _similarity())
    return pairs.where(F.col("similarity") >= least).select("doc_id", "section", "p1", "p2", "similarity")


def _change_least(n1, n2, of, left, right):
    """The similarity that two versions need, by what either has and how much their numbers of terms differ."""
    has = {c: pc.list_value_length(of(c)).to_numpy(zero_copy_only=False) > 0 for c in ("ds", "ns", "bs")}
    some = lambda c: has[c][left] | has[c][right]
    return np.where(some("ds"), 0.45, np.where(abs(n1 - n2) > 2, 0.10, np.where(some("ns") | some("bs"), 0.55, 0.60)))


def _signed(rows: DataFrame) -> DataFrame:
    """Units with their dates, numbers and abbreviations."""
    return rows.withColumns({"ds": dates(F.col("text")), "ns": numbers(F.col("text")), "bs": abbreviations(F.col("text"))})


def change_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of units of one section of a document, the earlier one first, that share terms enough to be versions of each other, with similarity and signals.

    Units meet on terms they share; a section is a part of one document, so a pair needs no other bound.
    """
    pairs = shared_terms(_signed(rows), _change_least, ["norm", "ds", "ns", "bs"]).withColumn("similarity", _similarity())
    some = lambda c: (F.size(f"{c}1") > 0) | (F.size(f"{c}2") > 0)
    skew = F.abs(F.col("n1") - F.col("n2")) > 2
    least = F.when(some("ds"), 0.45).when(skew, 0.10).when(some("ns") | some("bs"), 0.55).otherwise(0.60)
    kept = pairs.where((F.col("similarity") >= least) & (F.col("norm1") != F.col("norm2")))
    for i in ("1", "2"):
        kept = kept.withColumn(f"seq{i}", words_of(F.col(f"norm{i}"))).withColumn(f"terms{i}", F.array_sort(F.array_distinct(f"seq{i}")))
    return kept


def changes(rows: DataFrame, most: int | None = None) -> DataFrame:
    """What changed between the units of one section that are versions of each other, as `change_pairs` tells: kind, left and right value, family key. With `most`, the likest so many at least."""
    found = section_changes(_signed(rows), _change_least, most).withColumn("similarity", F.round(F.col("both") / F.col("either"), 9))
    return found.where(F.col("similarity") >= F.col("need")).select("doc_id", "section", "paragraph1", "unit1", "paragraph2", "unit2", "kind", "left_value", "right_value", "family", "similarity")


def simhash(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """64-bit signatures of rows by their terms: the sign of each bit's weighted sum, a term's bits those of its MD5's first half, its weight 1 / sqrt(df + 1) in millionths, so that sums are exact. Terms travel as their MD5."""
    half = lambda at: F.conv(F.substring(F.col("d"), at, 16), 16, -10).cast("bigint")
    digests = rows.select(key, F.explode(F.transform(terms, lambda t: F.md5(t.cast("binary")))).alias("d"))
    posts = digests.select(key, half(1).alias("h"), half(17).alias("l")).withColumn("df", F.count("*").over(Window.partitionBy("h", "l")))
    # sums of 64 bits are wider than the terms that a row has in one partition, so terms travel and not sums
    weighted = posts.select(key, "h", F.round(1000000 / F.sqrt(F.col("df") + 1)).cast("bigint").alias("w")).repartition(key)
    bit = lambda b: F.when(F.shiftrightunsigned("h", b).bitwiseAND(1) == 1, F.col("w")).otherwise(-F.col("w"))
    sums = weighted.groupBy(key).agg(*(F.sum(bit(b)).alias(f"b{b}") for b in range(64)))
    signature = F.lit(0).cast("bigint")
    for b in range(64):
        signature = signature.bitwiseOR(F.when(F.col(f"b{b}") >= 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return sums.select(key, signature.alias("signature"))


def bands(signature: Column) -> Column:
    return F.array(*(F.shiftrightunsigned(signature, 16 * b).bitwiseAND(0xFFFF) + F.lit(b << 16) for b in range(4)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_matches(asked: DataFrame, signed: DataFrame, key: str, most: int = 12) -> DataFrame:
    """Rows of `signed` that share a band with an asked signature and differ from it in `most` bits at most. The asked rows are a stated query set. Of rows that differ in more than 3 bits some have no band in common: `hamming_matches` finds all."""
    q = asked.select(F.col(key).alias("asked"), F.col("signature").alias("s1"), F.explode(bands(F.col("signature"))).alias("band"))
    found = signed.select(F.col(key).alias("found"), F.col("signature").alias("s2"), F.explode(bands(F.col("signature"))).alias("band"))
    return q.join(found, "band").where("asked <> found").select("asked", "found", hamming(F.col("s1"), F.col("s2")).alias("distance")).where(F.col("distance") <= most).distinct()


def hamming_matches(asked: DataFrame, signed: DataFrame, key: str, most: int = 12) -> DataFrame:
    """All signatures within `most` bits of the asked ones: asked and found (the smallest keys of a signature's rows), distance, n_asked and n_found (rows of either signature).

    Exact: of four bands of 16 bits, one differs in `most` / 4 bits at most, so each asked band is looked up with every such change of it, by equality.
    Rows of one signature are one class on either side, so copies are not paired; of several bands that find a pair the first counts. A class's distance to itself is 0.
    The asked rows are a stated query set; null signatures have no class. The changed bands are 2788 rows of each asked class, which no size estimate knows of, so they are shuffled and never broadcast.
    """
    near = most // 4
    classes = lambda d, n: d.where("signature is not null").groupBy(F.col("signature").alias(f"s{n}")).agg(F.min(key).alias(("asked", "found")[n - 1]), F.count("*").alias(("n_asked", "n_found")[n - 1]))
    changes = F.lit([m for m in range(1 << 16) if m.bit_count() <= near])
    q = classes(asked, 1).select("*", F.posexplode(bands(F.col("s1"))).alias("b", "band")).select("*", F.explode(changes).alias("change")).select("asked", "n_asked", "s1", "b", F.col("band").bitwiseXOR(F.col("change")).alias("band"))
    met = q.hint("merge").join(classes(signed, 2).select("*", F.explode(bands(F.col("s2"))).alias("band")), "band").withColumn("distance", hamming(F.col("s1"), F.col("s2"))).where(F.col("distance") <= most)
    apart = F.col("s1").bitwiseXOR(F.col("s2"))
    earlier = lambda b: (F.col("b") > b) & (F.bit_count(F.shiftrightunsigned(apart, 16 * b).bitwiseAND(0xFFFF)) <= near)
    return met.where(~(earlier(0) | earlier(1) | earlier(2))).select("asked", "found", "distance", "n_asked", "n_found")


def shingle_matches(asked: DataFrame, rows: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Rows whose shingles are like an asked row's by Jaccard, least above 0.

    A like row has `least` of the asked row's shingles, so it has one of any n - least * n + 1 of them: rows meet on the rarest so many, by hashes, and are compared by
    their shingles afterwards. Frequent shingles make no pairs.
    """
    side = lambda d, name, n: d.where(F.size("shingles") > 0).select(F.col(key).alias(name), F.size("shingles").alias(n), F.explode(F.transform("shingles", lambda s: F.xxhash64(s))).alias("s"))
    whole = lambda d, name: d.select(F.col(key).alias(name), F.col("shingles").alias(f"of_{name}"))
    met = _met_on_rarest(side(asked, "asked", "n1"), side(rows, "found", "n2"), least)
    return _like_shingles(met.join(whole(asked, "asked"), "asked").join(whole(rows, "found"), "found"), least)


def text_matches(asked: DataFrame, rows: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """The same of rows with a text, without their shingles: hashes are made in the tasks (`contexts.shingle_hashes`), and only those that asked rows may have become rows. Texts that meet are compared by their shingles themselves."""

    def side(d, name, n, table=None):
        made = d.where("text is not null").select(F.col(key).alias(name), runs_of.shingle_hashes(F.col("text"), table).alias("of"))
        return made.select(name, F.col("of.n").alias(n), F.explode("of.hashes").alias("s"))

    def whole(d, name):
        return d.select(F.col(key).alias(name), F.col("text").alias(f"text_{name}"))

    own = side(asked, "asked", "n1")
    met = _met_on_rarest(own, side(runs_of.spread(rows.select(key, "text"))[0], "found", "n2", runs_of.asked_bits(own, "s")), least)
    both = met.join(whole(asked, "asked"), "asked").join(whole(rows, "found"), "found")
    for name in ("asked", "found"):
        both = both.withColumn("norm", T.normalize_search(F.col(f"text_{name}"))).withColumn(f"of_{name}", shingles(words_of(F.col("norm")), F.col("norm"))).drop("norm", f"text_{name}")
    return _like_shingles(both, least)


def _met_on_rarest(own: DataFrame, posts: DataFrame, least: float) -> DataFrame:
    """(asked, found, n1, n2) of rows that share one of the rarest shingles (s) of an asked row and may be like by their sizes."""
    df = posts.groupBy("s").agg(F.count("*").alias("df"))
    rarest = own.join(df, "s").groupBy("asked", "n1").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by_df"))  # the shingles of one row
    prefix = F.slice("by_df", 1, (F.col("n1") - F.ceil(F.col("n1") * least - 1e-6) + 1).cast("int"))
    first = rarest.select("asked", "n1", F.explode(F.filter(prefix, lambda x: x["df"] > 1)).alias("x")).select("asked", "n1", "x.s")
    sizes = F.least("n1", "n2") >= F.greatest("n1", "n2") * least - 1e-6
    return first.join(posts, "s").where((F.col("asked") != F.col("found")) & sizes).select("asked", "found", "n1", "n2").distinct()


def _like_shingles(both: DataFrame, least: float) -> DataFrame:
    rows = both.withColumn("n", F.size(F.array_intersect("of_asked", "of_found")))
    return rows.withColumn("similarity", F.round(F.col("n") / (F.col("n1") + F.col("n2") - F.col("n")), 9)).where(F.col("similarity") >= least).select("asked", "found", "similarity")


@dataclass(frozen=True)
class Query:
    """A parsed query: its text without filters, words in order, sorted distinct terms, quoted phrases, a NEAR clause, its question word, what a title or question it looks like, and filters on sections and headings."""

    text: str
    words: list[str]
    phrases: list[list[str]] = field(default_factory=list)
    near: tuple[str, str, int] | None = None
    asks: str | None = None
    wants: str = "rank"
    intent: str = "concept"
    section: str = ""
    heading: str = ""

    @property
    def terms(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def norm(self) -> str:
        return " ".join(self.words)


def _filters(query: str) -> tuple[str, str, str]:
    """(rest, section, heading) of `section contains X`, `section: X` and the same of headings; a value is quoted, or goes on to the end."""
    found, rest = {"section": "", "heading": ""}, query
    while m := re.search(r"(heading|section)( contains|:)\s*", rest, re.IGNORECASE):
        head, tail = rest[: m.start()], rest[m.end() :]
        quote = tail[:1] if tail[:1] in ("'", '"') and tail else ""
        value, _, after = tail[1:].partition(quote) if quote else (tail, "", "")
        found[m[1].lower()] = value.strip()
        rest = f"{head} {after}" if head and not head[-1].isspace() else head + after
    return rest.strip(), found["section"], found["heading"]


def _intent(query: str, words: list[str], asks: str | None) -> str:
    """title, question or concept, by marks, length, capitals and question words."""
    question = asks is not None or "?" in query
    few = len(set(words)) <= 3 and len(query.encode()) <= 40
    runs = re.findall("[A-Za-z0-9]+", query)
    titled = [r[0].isupper() or (r.upper() == r and re.search("[A-Z]", r) is not None) for r in runs]
    lowered = [not t and re.search("[a-z]", r) is not None for r, t in zip(runs, titled, strict=True)]
    if any(mark in query for mark in ('"', "'", ":", " - ", " | ")) or (few and not question and (len(set(words)) == 1 or (any(titled) and not any(lowered)))):
        return "title"
    return "question" if question else "concept"


def parse(query: str) -> Query:
    """Words, `"phrases"`, `a NEAR/n b`, filters, and whether duplicates, unique units or changes are wanted."""
    text, section, heading = _filters(query)
    low = text.lower()
    clause = re.search(r"([a-z0-9]+)\s+near/(\d+)\s+([a-z0-9]+)", low)
    bare = re.sub(r"\bnear/\d+\b", " ", low) if clause else low
    wants = "duplicate" if "duplicate" in low or "repeated" in low else "unique" if "unique" in low else "change" if re.search(r"chang\w* (value|date|entity)|(value|date|entity) changed", low) else "rank"
    asks = next((w for w in CUES if re.match(rf"{w}\b", low)), None)
    phrases = [re.findall("[a-z0-9]+", p) for p in re.findall(r'"([^"]+)"', low)]
    words = re.findall("[a-z0-9]+", bare)
    return Query(text, words, phrases, (clause[1], clause[3], int(clause[2])) if clause else None, asks, wants, _intent(text, words, asks), section, heading)


def _holds(haystack: Column, needle: str) -> Column:
    """Whether normalised text has a filter's text, or all of its words somewhere."""
    norm = " ".join(re.findall("[a-z0-9]+", needle.lower()))
    if not norm:
        return F.lit(False)
    words = F.lit(True)
    for w in norm.split(" "):
        words = words & haystack.contains(w)
    return haystack.contains(norm) | words


def structural(rows: DataFrame, q: Query) -> DataFrame:
    """Units that a query's filters leave: those of sections whose heading has the section's text, and those that have the heading's text themselves or in their heading."""
    if q.section:
        rows = rows.where(_holds(T.normalize_search(F.col("heading")), q.section))
    if q.heading:
        rows = rows.where(_holds(F.col("norm"), q.heading) | _holds(T.normalize_search(F.col("heading")), q.heading))
    return rows


def may_say(text: Column, *terms: str) -> Column:
    """Whether a text has one of some terms as a word of its own, so that a unit of it can."""
    return text.rlike("(?i)(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, terms)) + ")(?![A-Za-z0-9])")


def may_match(text: Column, query: str) -> Column:
    """Whether a text can hold a unit that a query finds: one with a term, where filters leave no others."""
    q = parse(query)
    return may_say(text, *q.terms) if q.terms and not (q.section or q.heading) else F.lit(True)


def _at(words: list[str]) -> Column:
    return sequence_at(F.col("seq"), F.array(*map(F.lit, words)))


def priority(q: Query) -> Column:
    """A cheap measure of how much a unit has to do with a query, for the choice of those that are scored."""
    c = F.col
    out = F.when(c("text") == q.text, 120.0).otherwise(0.0) + 8.0 * c("matched")
    if q.norm:
        out += F.when(c("norm") == q.norm, 90.0).when(c("norm").contains(q.norm), 35.0).otherwise(0.0)
    for hit, more in ((reduce(Column.__or__, (c("norm").contains(" ".join(p)) for p in q.phrases if p), F.lit(False)), 25.0), (_at(q.words) >= 0 if not q.phrases and len(q.words) >= 2 else F.lit(False), 18.0), (c("is_heading"), 12.0), (c("title_like"), 6.0), (c("cover_like"), -4.0)):
        out += F.when(hit, more).otherwise(0.0)
    return out if q.asks else out + F.when(~c("title_like") & ~c("cover_like"), 1.0).otherwise(0.0)


def _signatures(q: Query, score: Column, exact: Column) -> Column:
    """What dates, numbers and abbreviations of a query add; a number or abbreviation that a unit lacks takes off, unless its text is the query's."""
    c, text = F.col, F.col("text")
    size = lambda of: len(_signed_query(of, q.text))
    asked = lambda of: F.lit(_signed_query(of, q.text))
    when = q.asks == "when"
    both = lambda of: F.size(F.array_intersect(of(text), asked(of)))

    def found(of, each, all_):
        return T.once(both(of), lambda n: F.when(n > 0, each * n + F.when(n == size(of), all_).otherwise(0.0)).otherwise(0.0))

    if size(dates):
        score += found(dates, 7.5, 4.0)
        if when:
            score += F.when(both(dates) > 0, 2.0).otherwise(-3.5)
    if when:
        score += F.when(F.size(dates(text)) > 0, 1.8).otherwise(-0.8)
    if size(numbers):
        score += found(numbers, 4.5, 2.0) + F.when(both(numbers) > 0, F.when(text.rlike("[$%]"), 0.4).otherwise(0.0)).otherwise(F.when(exact, 0.0).otherwise(-0.6))
    if size(abbreviations):
        score += found(abbreviations, 4.5, 2.0) + F.when(both(abbreviations) > 0, F.when(F.regexp_count(text, F.lit("[.]")) >= 2, 0.4).otherwise(0.0)).otherwise(F.when(exact, -1.0).otherwise(-1.8))
    return score


def _signed_query(of, text: str) -> list[str]:
    """Dates, numbers or abbreviations of a query, as `dates`, `numbers` and `abbreviations` find them in columns."""
    if of is numbers:
        return sorted({re.sub("[$,]", "", x).lower() for x in re.findall(NUMERIC, text)})
    if of is abbreviations:
        return sorted({re.sub(r"\.$", "", x).lower() for x in re.findall(ABBREVIATION, text)})
    iso = {"-".join((y, m.zfill(2), d.zfill(2))) for y, m, d in (re.split("[-/.]", x) for x in re.findall(ISO_DATE, text))}
    long = {f"{x.split(' ')[2]}-{str((MONTHS.index(x[:3].lower()) + 3) // 3).zfill(2)}-{x.split(' ')[1].replace(',', '').zfill(2)}" for x in re.findall(LONG_DATE, text)}
    return sorted(iso | long)


def calibrated(q: Query, score: Column) -> Column:
    """A score times a factor of .5 to 1.6 by how it came about: exact text, phrases, nearness, coverage, the shapes of query and unit, and the unit's length."""
    c = F.col
    when = lambda cond, more: F.when(cond, more).otherwise(0.0)
    n = len(q.terms)
    factor = F.lit(1.0) + when(c("exact"), 0.3) + F.least(0.18 * c("phrases"), F.lit(0.36)) + when(c("near") > 0, F.least(F.lit(0.15), c("near") / 20.0))
    if n:
        factor += F.least(F.lit(0.2), c("matched") / n * 0.16) + when((c("matched") == n) & ~c("exact"), 0.08)
    if q.intent == "title":
        factor += when(c("title_like"), 0.12) - when(c("cover_like"), 0.05)
    elif q.intent == "question":
        factor += when(~c("title_like") & ~c("cover_like"), 0.08) - when(c("cover_like") & ~c("exact"), 0.08)
    factor += when(c("is_heading"), 0.08) + F.when(c("alone"), 0.1).otherwise(-0.05)
    size = F.octet_length("text")
    factor += F.when((size <= 32) | (c("n_terms") <= 3), -0.18).when((size <= 64) | (c("n_terms") <= 5), -0.1).when(size >= 260, -0.04).otherwise(0.0)
    return F.greatest(score, F.lit(0.0)) * F.greatest(F.lit(0.5), F.least(F.lit(1.6), factor))


#: What a phrase adds in turn, somewhere inside, and what words in turn add, by the unit's shape (cover, title, other), for queries like titles and for others.
RUNS = {True: ((1.0, 4.2, 6.5), (0.9, 2.2, 3.2), (0.85, 1.8, 2.8)), False: ((0.15, 3.0, 6.5), (0.1, 1.4, 3.2), (0.35, 1.0, 2.8))}


def search(rows: DataFrame, query: str, n: int = 20) -> DataFrame:
    """The n best units for a query: score, its calibrated value, matched terms and why. Frequencies of the query's terms are counted first and become weights; no unit is shuffled but those that score.

    Units are made once: those with a term are written, then counted and scored. Filters leave units without a term as well and make all of them twice.

    For three hits or fewer, the 32 units of the highest priority alone are scored: every task keeps so many. Filters without terms rank all units that they leave, a query with neither all units.
    """
    q, c = parse(query), F.col
    letters = c("text").rlike("(?i)" + "|".join(map(re.escape, q.terms)))  # texts without them are not normalised
    having, filtered = rows.where(letters & F.arrays_overlap("seq", F.array(*map(F.lit, q.terms)))) if q.terms else rows, bool(q.section or q.heading)
    if q.terms and not filtered:
        made = folders.written(having.select("doc_id", "paragraph", "unit", "text", "norm", "is_heading", "alone", "n_terms", "title_like", "cover_like"), "hits")
        having = made.withColumn("seq", words_of(c("norm"))).withColumn("terms", F.array_sort(F.array_distinct("seq")))
    counted = having.agg(*(F.count_if(F.array_contains("seq", t)).alias(t) for t in q.terms)).first().asDict() if q.terms else {}
    weight = {t: 1.0 / n for t, n in counted.items() if n}
    has = {t: F.array_contains("terms", t) for t in q.terms}
    hits = structural(rows, q) if filtered else having
    hits = hits.withColumn("matched", sum((has[t].cast("int") for t in q.terms), F.lit(0)))
    if n <= 3:
        hits = hits.orderBy(priority(q).desc(), "doc_id", "paragraph", "unit").limit(32)
    titled = q.intent == "title"
    by_shape = lambda values: F.when(c("cover_like"), values[0]).when(c("title_like"), values[1]).otherwise(values[2])
    own, exact = c("text") == q.text, c("norm") == q.norm if q.norm else F.lit(False)
    score = F.lit(0.0)
    for t in q.terms:
        score += F.when(has[t], weight.get(t, 0.0)).otherwise(0.0)
    if q.section:
        score += F.when(T.normalize_search(c("heading")).contains(" ".join(re.findall("[a-z0-9]+", q.section.lower()))), F.when(c("is_heading"), 8.0).otherwise(1.0)).otherwise(0.0)
    if q.heading:
        norm = " ".join(re.findall("[a-z0-9]+", q.heading.lower()))
        score += F.when(c("is_heading"), 6.0).otherwise(0.0) + F.when(c("norm").contains(norm), 4.5).otherwise(0.0) + F.when(T.normalize_search(c("heading")).contains(norm), 2.0).otherwise(0.0)
    score = _signatures(q, score, own | exact)
    score += F.when(own, 10.0).otherwise(0.0) + F.when(exact, 5.0).otherwise(0.0)
    if q.norm:
        score += F.when(c("norm").contains(q.norm), 1.5).otherwise(0.0)
    runs, found = [(p, *RUNS[titled][:2]) for p in q.phrases if p] or ([(q.words, RUNS[titled][2], None)] if not q.phrases and len(q.words) >= 2 else []), F.lit(0)
    for words, in_turn, inside in runs:
        at = _at(words)
        part = c("norm").contains(" ".join(words)) if inside else F.lit(False)
        score += F.when(at >= 0, by_shape(in_turn) + F.when(at == 0, 0.75).otherwise(0.0)).when(part, by_shape(inside or (0.0, 0.0, 0.0))).otherwise(0.0)
        found += F.when((at >= 0) | part, 1).otherwise(0)
    if q.terms:
        score += 2.0 * c("matched") / len(q.terms) + F.when(c("matched") == len(q.terms), 1.0).otherwise(0.0)
    close = near(c("seq"), *q.near) if q.near else F.lit(0.0)
    ours = sorted({"|".join(q.words[i : i + 3]) for i in range(len(q.words) - 2)} or ({q.norm} if q.norm else set()))
    if ours:
        both = F.size(F.array_intersect(shingles(c("seq"), c("norm")), F.array(*map(F.lit, ours))))
        score += 2.2 * both / (F.size(shingles(c("seq"), c("norm"))) + len(ours) - both)
    score += close
    if not titled:
        score += F.when(c("cover_like") & ~own & ~exact, -5.0).otherwise(0.0)
    loose = F.when(c("cover_like"), -0.7).when(~c("title_like"), -0.2) if titled else F.when(c("cover_like"), -3.6).when(c("title_like"), -0.8)
    score += F.when(~own & ~exact & (found == 0) & (close <= 0), loose.otherwise(0.0)).otherwise(0.0)
    score += 0.4 / F.greatest(c("n_terms"), F.lit(1)) + 0.15 / (F.floor(F.octet_length("text") / 40) + 1)
    for i, (_, boost) in enumerate(CUES.get(q.asks, ())):
        score += F.when(cue(c("text"), q.asks, i), boost).otherwise(0.0)
    if not q.terms and not q.asks and (q.section or q.heading):
        score += 0.5
    scored = hits.withColumns({"score": F.round(score, 6), "exact": own | exact, "phrases": found, "near": F.round(close, 6)}).where("score > 0")
    scored = scored.withColumn("calibrated", F.round(calibrated(q, c("score")), 6))
    reason = F.when(c("exact"), "exact").when(c("phrases") > 0, "phrase").when(c("near") > 0, "near").when((c("matched") == len(q.terms)) & (c("matched") > 0), "all terms").when(c("matched") > 0, "terms").otherwise("filter" if q.section or q.heading else "shape")
    order = [F.desc("exact"), F.desc("phrases"), F.desc("near"), F.desc("calibrated"), F.desc("is_heading"), F.desc("alone"), F.desc("score"), F.desc("matched"), F.octet_length("text"), c("paragraph"), c("unit"), c("doc_id")]
    # of equal units the best stays, then the order's first n
    best = F.row_number().over(Window.partitionBy("norm").orderBy(*order))
    kept = scored.withColumn("best", best).where("best = 1").withColumn("reason", reason).orderBy(*order).limit(n)
    return kept.select("doc_id", "paragraph", "unit", "text", "matched", "score", "calibrated", "reason")


def all_occurrences(rows: DataFrame, word: str) -> DataFrame:
    """Units that have a word, and how often, in the order of the text. Texts without its letters are passed over before they are normalised."""
    return rows.where(F.col("text").rlike("(?i)" + re.escape(word)) & F.array_contains("seq", word)).select("doc_id", "paragraph", "unit", occurrences(F.col("norm"), word).alias("n")).orderBy("doc_id", "paragraph", "unit")


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """Groups of rows of one key, two at least: key, n and the first document."""
    # an empty key is no row of a generator; as a filter it would go below the units and make each key again
    keyed = rows.select("doc_id", F.explode(F.filter(F.array(key), lambda k: k != "")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 2")


def next_terms(docs: DataFrame, k: int = 16) -> DataFrame:
    """For each run of up to three words of a text (and none), the k that most often follow, ties by the alphabet.

    Runs travel as packed codes and are counted where they land (`contexts`); the words of all texts are counted for the context of none.
    """
    words = docs.where("text is not null").select(F.explode(native_terms(F.col("text"))).alias("next_term")).groupBy("next_term").agg(F.count("*").alias("n"))
    none = words.orderBy(F.desc("n"), "next_term").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "next_term")))  # k rows
    return runs_of.next_terms(docs, k).unionByName(none.select(F.lit(0).alias("order"), F.lit("").alias("context"), "next_term", "n", "rank"))


def _ranked(rows: DataFrame, longest: int, k: int, term: str) -> DataFrame:
    """(order, context, term, n, rank) of contexts of `longest` words and all shorter ones, down to none; rows of fewer words count for the shorter ones only."""
    found = []
    for m in range(longest, -1, -1):
        # a context has one order; as an aggregate it is no filter before the exchange, which both readers share
        counts = (rows.repartition("context") if m else rows).groupBy("context", term).agg(F.sum("n").alias("n"), F.max("order").alias("order"))
        rank = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("n"), term))
        found.append(counts.where(F.col("order") == m).withColumn("rank", rank).where(F.col("rank") <= k).select(F.lit(m).alias("order"), "context", term, "n", "rank"))
        shorter = F.when(F.col("order") < m, F.col("context")).otherwise(F.substring_index("context", " ", 1 - m) if m > 1 else F.lit(""))
        rows = counts.select(F.least("order", F.lit(m - 1)).alias("order"), shorter.alias("context"), term, "n")
    return reduce(DataFrame.unionByName, found)


#: What stands before an island's first words, and the signs that end an island.
START, ISLAND_ENDS = "<s>", (".", "!", "?", "\n")


def ngram_contexts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, p3, p2, p1, term): words and end signs of a text in order, each with the three before it in its sentence island; `<s>` stands for those before its start. Null and empty texts have none."""

    def placed(q):
        ends = lambda i: F.get(q, i).isin(*ISLAND_ENDS)
        one = lambda i: (i >= 1) & ~ends(i - 1)
        two = lambda i: one(i) & (i >= 2) & ~ends(i - 2)
        three = lambda i: two(i) & (i >= 3) & ~ends(i - 3)
        before = lambda i, n, ok: F.when(ok(i), F.get(q, i - n)).otherwise(START).alias(f"p{n}")
        return F.transform(F.sequence(F.lit(0), F.size(q) - 1), lambda i: F.struct(i.alias("place"), before(i, 3, three), before(i, 2, two), before(i, 1, one), F.get(q, i).alias("term")))

    words = F.regexp_extract_all(T.lower_ascii(F.col("text")), F.lit(r"[a-z0-9]+|[.!?\n]"), 0)
    return docs.where("text is not null").select(key, F.inline(T.once(words, lambda q: F.when(F.size(q) > 0, placed(q)))))


def predictor(contexts: DataFrame, k: int = 16) -> DataFrame:
    """(order, context, guesses): for the last three, two, one and no words before it, the k terms that most often follow, ties by the alphabet.

    Counts of whole contexts are summed before shorter ones are counted from them, so each level reads fewer rows.
    """
    rows = contexts.select(F.lit(3).alias("order"), F.concat_ws(" ", "p3", "p2", "p1").alias("context"), "term", F.lit(1).cast("bigint").alias("n"))
    return _ranked(rows, 3, k, "term").groupBy("order", "context").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("guesses"))  # k at most


def predictions(contexts: DataFrame, table: DataFrame) -> DataFrame:
    """Contexts and terms, n (how often they occur), order and place: the longest context that the table knows, and where the term is among its guesses, from 1; 0 where it isn't, null order where the table is empty."""
    asked = contexts.groupBy("p3", "p2", "p1", "term").agg(F.count("*").alias("n")).withColumns({"order": F.lit(None).cast("int"), "place": F.lit(None).cast("bigint")})

    def judged(rows, m):  # guesses end here: a place and an order go on
        new, known = F.col("order").isNull() & F.col("guesses").isNotNull(), F.col("order")
        place = F.when(new, F.array_position("guesses", F.col("term"))).otherwise(F.col("place"))
        return rows.select("p3", "p2", "p1", "term", "n", F.when(new, m).otherwise(known).alias("order"), place.alias("place"))

    for m in (3, 2, 1):
        table_m = table.where(F.col("order") == m).select("context", "guesses")
        asked = judged(asked.withColumn("context", F.concat_ws(" ", *(f"p{j}" for j in range(m, 0, -1)))).join(table_m, "context", "left"), m)
    none = table.where("order = 0").agg(F.first("guesses").alias("guesses"))  # one row
    return judged(asked.crossJoin(F.broadcast(none)), 0).withColumn("place", F.coalesce("place", F.lit(0)))


def judged(docs: DataFrame, k: int = 16) -> DataFrame:
    """(order, n, first, among) of the words and end signs of texts that are `held`, as the others' words predict them: how many fell to each order of context, were the first guess, and were among the k.

    The same as `predictions` by a `predictor` of the others, without a table of guesses: runs travel as packed codes (`contexts`). The guesses of no context are those of all words.
    """
    words = F.regexp_extract_all(T.lower_ascii(F.col("text")), F.lit(r"[a-z0-9]+|[.!?\n]"), 0)
    said = docs.where("text is not null and not held").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)
    none = said.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), lambda x: x["term"]).alias("guesses"))  # k at most
    place = F.when(F.col("order") == 0, F.array_position("guesses", F.col("term")))
    rows = runs_of.predicted(docs, k).crossJoin(F.broadcast(none)).withColumn("place", place)
    some = lambda done, is_hit: F.sum(F.coalesce(done, F.when(is_hit, F.col("n")).otherwise(0)))
    return rows.groupBy("order").agg(F.sum("n").alias("n"), some(F.col("first"), F.col("place") == 1).alias("first"), some(F.col("among"), F.col("place") > 0).alias("among"))


def unique_units(rows: DataFrame) -> DataFrame:
    """Units that no other equals, by normalised text. Units are made once: of a group of one, its first row is all of it."""
    whole = ("doc_id", "paragraph", "unit", "text")
    return rows.groupBy("norm").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in whole)).where("n = 1").select(*whole)


def top_duplicates(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n largest groups of units of one family."""
    return duplicates(rows, family_key(F.col("norm"))).orderBy(F.desc("n"), "first_doc", "key").limit(n)


def top_changes(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n likest changes between units."""
    return changes(rows, n).orderBy(F.desc("similarity"), "doc_id", "paragraph1", "unit1", "paragraph2", "unit2").limit(n)


CHANGE = re.compile(r"chang\w* (value|date|entity|number)\s*(?:of|from|:)?\s*(.*?)\s*(?:->|to)\s*(.*)$|(value|date|entity|number) changed", re.IGNORECASE)


def change_query(query: str) -> tuple[str, str, str] | None:
    """(kind, left, right) of `changed value X -> Y` and its like; empty sides where only the kind is asked."""
    m = CHANGE.search(query)
    if not m:
        return None
    kind = (m[1] or m[4]).lower()
    return ("" if kind == "value" else f"change-{kind}", *(" ".join(re.findall("[a-z0-9]+", (s or "").lower())) for s in (m[2], m[3])))


def can_change(text: Column, query: str) -> Column:
    """Whether a text can hold a side of an asked change: either side of a changed number or date has a digit."""
    kind, _, _ = change_query(query) or ("", "", "")
    return text.rlike("[0-9]") if kind in ("change-number", "change-date") else F.lit(True)


def asked_changes(paras: DataFrame, query: str) -> DataFrame:
    """Changes of the asked kind between the asked values, from paragraphs with their sections. Only what can hold a side of one is cut into units and met."""
    can = can_change(F.col("text"), query)
    return matching_changes(changes(units(paras.where(can)).where(can)), query)


def matching_changes(found: DataFrame, query: str) -> DataFrame:
    """Changes of the asked kind between the asked values, in either direction."""
    kind, left, right = change_query(query) or ("", "", "")
    rows = found.where(F.col("kind") == kind) if kind else found
    if not left and not right:
        return rows
    one = (F.col("left_value") == left) & (F.col("right_value") == right)
    return rows.where(one | ((F.col("left_value") == right) & (F.col("right_value") == left)))
