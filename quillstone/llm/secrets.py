"""Operator 6, secret scans, by DataFrame and SQL functions only.

Three patterns give base findings. Beside them, tokens of key-like characters are judged by two character
Markov models, one of random strings and one of ordinary identifiers: a token is a secret when its
log-likelihood ratio outweighs `LOG_ODDS`, the prior odds against. Both models are first-order counts
over labelled samples, taken as a DataFrame.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh

#: Fixed patterns: kind, pattern, the group whose length counts, its least length, and a cheap pattern that every text with a match matches.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
MARKOV = "markov"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
#: As short as a value of the assign pattern; above it the ratio alone decides.
LEAST_TOKEN = 8
#: Nats by which a token must look more random than ordinary.
LOG_ODDS = 14.0
#: Generated random strings that the random model is counted on.
RANDOM_STRINGS = 12000
SMOOTH, BACK_OFF = 0.5, 4.0


#: Matches of a text whose spans are gathered at once.
RUN = 256
NONE = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, pattern: str, group: int, kind: str, rank: int, ok) -> Column:
    """Spans (start, rank, kind, end) of all leftmost non-overlapping matches whose group `ok` takes."""
    # what lies between matches, and the matches, give all places: no built-in function returns them
    between = F.transform(F.split(text, pattern, -1), F.length)
    match = F.regexp_extract_all(text, F.lit(pattern), 0)
    none = F.array().cast(NONE)

    def step(acc, x):
        start = acc["at"] + x["between"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["whole"]).alias("end"))
        return F.struct((start + x["whole"]).alias("at"), F.when(ok(x["part"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def zipped(found):
        part = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
        return F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), F.transform(found, F.length).alias("whole"), part.alias("part"))

    def gathered(all_):
        def run(acc, k):  # appending copies what is there, so spans are gathered by runs of matches
            inner = F.aggregate(F.slice(all_, k * RUN + 1, RUN), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

        runs = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NONE}>").alias("out")), run, lambda acc: F.flatten(acc["out"]))

    return _once(_once(match, zipped), gathered)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str, group: int, least: int, cheap: str, kind: str, rank: int) -> Column:
    """Spans of the matches that are long enough."""
    return F.when(text.rlike(cheap), _spans(text, pattern, group, kind, rank, lambda part: F.length(part) >= least)).otherwise(F.array().cast(NONE))


def default_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, random): generated random strings, and identifiers from the distinct words of all documents."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.base64(F.unhex(digest))
    made = spark.range(RANDOM_STRINGS).select(F.element_at(F.array(code, F.substring(digest, 1, 40), F.upper(code)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit(True).alias("random"))
    picked = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null")
    words = picked.select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z]{3,}"), 0)).alias("w")).distinct()
    w = F.col("w")
    shapes = [w, F.concat(w, F.lit("_"), w), F.concat(w, F.lit("-"), w), F.concat(w, F.lit("/"), w), F.concat(w, F.initcap(w)), F.concat(w, F.crc32(w.cast("binary")) % 1000), F.concat(w, F.lit("="), w), F.upper(w), F.concat(F.crc32(w.cast("binary")).cast("string"), F.lit("-"), F.crc32(w.cast("binary")).cast("string"))]
    plain = words.select(F.explode(F.array(*shapes)).alias("text"), F.lit(False).alias("random"))
    return made.union(plain)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of alphabet characters, first character major. What is collected is bounded by the alphabet."""
    pairs = samples.where("text is not null and random is not null and length(text) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
    rows = pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()
    n = len(ALPHABET)
    counts = {(r["random"], r["pair"]): r["count"] for r in rows}
    second = {(k, b): sum(counts.get((k, a + b), 0) for a in ALPHABET) for k in (True, False) for b in ALPHABET}
    every = {k: sum(second[k, b] for b in ALPHABET) for k in (True, False)}
    out = []
    for a in ALPHABET:
        first = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (True, False)}
        for b in ALPHABET:
            p = {}
            for k in (True, False):  # a pair's share, backed off to the second character's
                alone = (second[k, b] + SMOOTH) / (every[k] + SMOOTH * n)
                p[k] = (counts.get((k, a + b), 0) + BACK_OFF * alone) / (first[k] + BACK_OFF)
            out.append(round(math.log(p[True] / p[False]), 6))
    return out


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token of alphabet characters: random against ordinary."""
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1)))
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, (place(i) - 1) * len(ALPHABET) + place(i + 1)))


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, log_odds: float = LOG_ODDS, text_col: str = "text") -> DataFrame:
    """`docs` with columns base_spans and spans: arrays of (start, rank, kind, end), by start and then kind; code points, end exclusive. Columns of these names are replaced.

    base_spans are matches of the patterns; spans also has the tokens that the Markov models call
    random. A null text has no spans. Rows are otherwise as they were, repeated ones too.
    samples: (text string, random boolean); by default generated strings and words of `docs`. An empty table gives an empty result.
    """
    base, spans = fresh(docs.drop("base_spans", "spans"), "base_spans", "spans")
    return docs.drop("base_spans", "spans").withColumns(dict(zip((base, spans), _columns(docs, samples, log_odds, text_col), strict=True)))


def _columns(docs: DataFrame, samples: DataFrame | None, log_odds: float, text_col: str) -> tuple[Column, Column]:
    """base_spans and spans of each row of `docs`."""
    table = train(default_samples(docs, text_col=text_col) if samples is None else samples)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*(_found(text, p, g, n, cheap, kind, k) for k, (kind, p, g, n, cheap) in enumerate(BASE))))
    tokens = f"{TOKEN}{{{LEAST_TOKEN},}}"
    # nearly all texts have tokens and few have secrets: each token is judged once, and places are found where one is a secret
    secret = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(tokens), 0)), lambda t: ratio(t, table) > log_odds)
    markov = _once(secret, lambda found: F.when(F.size(found) > 0, _spans(text, tokens, 0, MARKOV, len(BASE), lambda t: F.array_contains(found, t))).otherwise(F.array().cast(NONE)))
    return base, F.array_sort(F.concat(base, markov))


def redact(docs: DataFrame, mark: str = "[SECRET]", samples: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with every found span of the text replaced by `mark`; overlapping spans are one.

    A null text stays null. All other columns stay as they are, whatever their names; repeated rows are treated each, an empty table stays empty.
    """
    found = fresh(docs, "spans")[0]
    text = F.col(text_col)

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text)))
    clean = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, rest)
    marked = docs.withColumn(found, _columns(docs, samples, LOG_ODDS, text_col)[1])
    return marked.withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_markov_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_spans(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(b[0]) for b in BASE), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))
