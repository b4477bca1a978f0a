"""Operator 7, quality rules: learned decision lists over text statistics.

Statistics of whole texts are counted in the tasks. From those of labelled rows (at most `ROWS_EACH` of
either label), sequential covering learns rules for label 0: a rule grows by the threshold that gains
most, one condition at a time, is pruned on rows kept back, and the rows it covers are set aside before
the next. The list is an ordered Spark conditional expression, so judging rows is plain SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import picked
from .store import bounded_batches

ROWS_EACH = 4000
MOST_RULES, MOST_CONDITIONS = 12, 4
#: A rule must be right in this share of the rows it covers, and cover so many.
PRECISION, LEAST_ROWS = 0.97, 5
#: Fixed set of symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_stops")
#: What rules are learned on: ratios of the counts.
RATIOS = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
}


def _table(which: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(which)] = True
    return out


_SYMBOL, _UPPER, _STOP = _table(SYMBOLS), _table(bytes(range(0x41, 0x5B))), _table(b".!?")


def _per(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marks between consecutive edges."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[edges])


def counts(texts) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow array."""
    w = W.split(texts)
    data, off, n = w.data, w.offsets, w.count
    lead = (data & 0xC0) != 0x80  # one for each code point
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # lines with a word, by their bytes: of the first of equal ones in a text on, each counts as a copy
    breaks = np.union1d(np.flatnonzero(data == 0x0A), off[1:])
    starts = np.union1d(np.flatnonzero(data == 0x0A) + 1, off[:-1])
    line = np.searchsorted(starts, w.start, "right") - 1 if len(w.start) else np.zeros(0, np.int64)
    lines = np.unique(line)
    begin = starts[lines]
    stop = breaks[np.searchsorted(breaks, begin, "right")] if len(lines) else begin
    doc = np.searchsorted(off, begin, "right") - 1
    copies = np.zeros(len(n), np.int64)
    seen: dict[tuple[int, bytes], int] = {}
    last = -1
    raw = data.tobytes()
    for d, a, b in zip(doc.tolist(), begin.tolist(), stop.tolist(), strict=True):
        if d != last:
            seen, last = {}, d
        text = raw[a:b]
        if text in seen:
            copies[d] += 1
        else:
            seen[text] = 1
    # words in 3-word windows that are in the text twice or more
    g, ok = W.windows(w, 3)
    at = np.flatnonzero(ok)
    owner = w.doc()[at]
    order = np.lexsort((g[at], owner))
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        pair = (g[at][order][1:] == g[at][order][:-1]) & (owner[order][1:] == owner[order][:-1])
        same[1:] |= pair
        same[:-1] |= pair
    edge = np.zeros(len(w.hash) + 1, np.int64)
    hit = at[order][same]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 3, -1)
    return {
        "n_words": n, "word_chars": _per(lead & inside, off), "n_symbols": _per(_SYMBOL[data], off), "n_dup_lines": copies,
        "n_repeat_words": _per(np.cumsum(edge[:-1]) > 0, w.first), "n_upper": _per(_UPPER[data], off),
        "n_lines": np.bincount(doc, minlength=len(n)), "n_stops": _per(_STOP[data], off),
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one), n_repeat_words (words in 3-word windows found twice or more), n_upper (A-Z), n_lines (with a word) and n_stops. A null text counts nothing; repeated rows are counted each. Other columns are not read, whatever their names; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for b in W.chunks(batches, "text"):
            found = counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return texts.mapInArrow(scan, f"doc_id {dict(texts.dtypes)['doc_id']}, " + ", ".join(f"{c} bigint" for c in COUNTS))


Rule = list[tuple[str, str, float]]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, cut in rule:
        out &= (x[name] >= cut) if sign == ">=" else (x[name] < cut)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The condition that raises precision on `rows` most, by the gain of information times what stays covered."""
    p0 = bad[rows].mean()
    best = (1e-9, None)
    for name, v in x.items():
        order = np.argsort(v[rows], kind="stable")
        s, b = v[rows][order], bad[rows][order].astype(float)
        edge = np.flatnonzero(s[1:] > s[:-1])
        if not len(edge):
            continue
        low = np.cumsum(b)[edge]
        n_low = edge + 1.0
        for sign, pos, n in (("<", low, n_low), (">=", b.sum() - low, len(b) - n_low)):
            gain = pos * (np.log((pos + 1e-9) / n) - np.log(p0))
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (name, sign, float((s[edge[k]] + s[edge[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 5) -> list[Rule]:
    """Ordered rules, each a conjunction of thresholds that marks bad rows."""
    n = len(bad)
    held = np.random.default_rng(seed).random(n) < 0.3
    left, rules = np.ones(n, bool), []
    while len(rules) < MOST_RULES and (bad & left & ~held).sum() >= LEAST_ROWS:
        rule, rows = [], np.flatnonzero(left & ~held)
        while len(rule) < MOST_CONDITIONS and 0 < bad[rows].mean() < 1:
            _, condition = _best(x, bad, rows)
            if condition is None:
                break
            rule.append(condition)
            rows = np.flatnonzero(left & ~held & _holds(rule, x, n))
        if not rule:
            break

        def worth(r: Rule, among=held & left) -> float:
            hit = _holds(r, x, n) & among
            return ((bad & hit).sum() - 3.0 * (~bad & hit).sum()) / max(1, (bad & among).sum())

        while len(rule) > 1:  # a condition that the held rows do not need goes
            shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        hit = _holds(rule, x, n) & left
        if hit.sum() < LEAST_ROWS or bad[hit].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, unless: Column | None = None, label: str = "quality", rows_each: int = ROWS_EACH, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules from labelled rows where `unless` is false; label 0 is bad. Without both labels there are none.

    Texts are counted in the tasks; of at most `rows_each` ids of either label the ratios alone are collected. Null
    labels, ids and texts are passed over, rows of one id count once, and an empty table has no rules.
    """
    ids = picked(labels, label, rows_each, F.lit(False) if unless is None else unless, id_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    counted = statistics(own.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"))  # at most 2 * rows_each ids are broadcast
    ratios = counted.groupBy("doc_id").agg(F.min(F.struct(*(F.expr(e).alias(c) for c, e in RATIOS.items()))).alias("r"))
    rows = sorted(ratios.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "r.*").collect(), key=lambda r: r.doc_id)
    bad = np.array([r.label == 0 for r in rows], bool)
    if not len(bad) or bad.all() or not bad.any():
        return []
    return learn({c: np.array([r[c] for r in rows]) for c in RATIOS}, bad)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule applies, as one ordered conditional over the statistics' columns."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, sign, cut in rule:
            value = F.expr(RATIOS[name])
            holds &= (value >= cut) if sign == ">=" else (value < cut)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def op7_decision_list_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(fit(docs, labels))).alias("kept"),
    )
