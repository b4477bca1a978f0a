"""Text, identity and scoring expressions, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense; Java's and RE2's \s know only the ASCII part.
WS = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
NOT_WS = "[^" + WS[1:-1]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "␟"
# What the statement kinds are recognised by, the first that matches.
KINDS = {
    "decision": r"decide|decided|we will|we'll|use .* instead|canonical|final",
    "constraint": r"must|never|cannot|can't|required|constraint|only",
    "task": r"todo|need to|next|should|implement|fix|build",
    "hypothesis": r"hypothesis|maybe|perhaps|could|might",
}
NEGATION = r"no|not|never|cannot|can't|without"
VALUE_VERBS = r"is|are|use|be|to"


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it (a lambda would compute it for each element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole_word(words: str) -> str:
    """A pattern for one of `words` between ASCII word ends, without look-around."""
    return rf"(?i)(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def normalize_text(c: Column) -> Column:
    """White space runs become one space, the ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, WS, " "))


def normalize_identity(c: Column) -> Column:
    return F.lower(normalize_text(F.coalesce(c.cast("string"), F.lit(""))))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def canonical_id(prefix: str, version: str, *parts: Column) -> Column:
    """prefix and the first 24 hex digits of the SHA-256 of version and parts; equal up to case and white space."""
    stable = F.concat_ws(SEPARATOR, normalize_identity(F.lit(version)), *(normalize_identity(p) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(stable.cast("binary"), 256), 1, 24))


def ascii_words(c: Column, least: int = 3) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, repeats kept."""
    return F.filter(F.split(lower_ascii(c), "[^a-z0-9]+"), lambda x: F.length(x) >= least)


def terms(c: Column, least: int = 3) -> Column:
    return F.array_distinct(ascii_words(c, least))


def unicode_terms(c: Column, cap: int) -> Column:
    """Distinct runs of letters, digits, _ and - of two characters or more, the first `cap`."""
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(normalize_text(c)), r"[^\p{L}\p{N}_-]+"), lambda x: F.length(x) >= 2)), 1, cap)


def normalize_search(c: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(c), "[^a-z0-9]+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda x: x != ""))


def slug(c: Column, most: int = 72, default: str = "untitled") -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(lower_ascii(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)
    return F.when(s == "", default).otherwise(s)


def title_keywords(c: Column) -> Column:
    """The first twelve words of a text that have four ASCII letters or digits or more."""
    return F.slice(F.filter(F.split(F.lower(normalize_text(c)), "[^a-z0-9]+"), lambda x: F.length(x) >= 4), 1, 12)


def sentences(c: Column) -> Column:
    """Sentences of four characters or more, or the whole text where there is none."""
    norm = normalize_text(c)
    found = F.filter(F.split(norm, r"(?<=[.!?])\s+"), lambda x: F.length(x) >= 4)
    return F.when(F.size(found) > 0, found).when(norm != "", F.array(norm)).otherwise(F.array().cast("array<string>"))


def statement_kind(c: Column) -> Column:
    out = F.lit("fact")
    for kind, words in reversed(KINDS.items()):
        out = F.when(c.rlike(whole_word(words)), kind).otherwise(out)
    return out


def statement_value(c: Column, kind: Column) -> Column:
    """What follows the last of a few verbs; none for a hypothesis."""
    after = F.trim(F.regexp_extract(F.concat(F.lit(" "), c), rf"(?is)^.*[^a-z0-9_]({VALUE_VERBS})([^a-z0-9_].*)$", 2))
    return F.when((kind != "hypothesis") & (after != ""), after)


def polarity(c: Column) -> Column:
    return F.when(c.rlike(whole_word(NEGATION)), "NEGATIVE").otherwise("NEUTRAL")


def role(c: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(r.isin("human", "user", "prompt"), "user").when(r.isin("assistant", "model", "bot", "ai"), "assistant").when(r == "", "unknown").otherwise(r)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))
