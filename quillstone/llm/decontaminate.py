"""Operator 1, benchmark decontamination by training suffix arrays.

Each task turns runs of its documents (shards, about `SHARD_BYTES` of text) into a sorted array of word
suffixes and binary-searches every test suffix in it. Shards keep only suffixes that begin with the
first two words of some test suffix: no other can hold a match. The search gives, for each distinct
window, the interval of training suffixes that begin with it (all occurrences, for removal), and for each
test suffix the longest verbatim match with its place. Arrays that matter for many words are sorted by prefix doubling, and words in common are counted
by doubling too, so long runs of one word cost little more than other text. Documents are never shuffled.

The test set is searched in blocks of at most `BLOCK_BYTES`, so what is broadcast is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Work, bounded_batches, join_checked

SHARD_BYTES = 4 << 20
#: Bytes of test texts that are searched at once; what is broadcast for them is about five times as large.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
#: Suffixes that matter for more words than these are sorted by prefix doubling.
SHALLOW = 32


class TestSet:
    """Test suffixes: word hashes of all items, and of each suffix its start, its item's end, its window's length and its item; the distinct windows (a suffix of each, and the items that have it)."""

    __test__ = False

    def __init__(self, ids, texts, window: int):
        w = W.split(pa.array(texts, pa.string()), W.ALNUM, lower=True)
        self.ids = np.array([None if i is None else str(i) for i in ids], object)
        seen: dict = {}
        same = np.array([seen.setdefault(i, k) for k, i in enumerate(self.ids)], np.int64)  # the first row of the item's id
        self.hash, self.sums = w.hash, _sums(w.hash)
        n, doc = w.count, w.doc()
        length = np.minimum(window, n)[doc]
        end = w.first[1:][doc]
        self.start = np.flatnonzero(np.arange(len(w.hash)) + length <= end)
        self.item, self.end, self.length = doc[self.start], end[self.start], length[self.start]
        self.word = self.start - w.first[self.item]
        self.depth, self.window = int(n.max(initial=0)), int(self.length.max(initial=0))
        key = _run(self.sums, self.start, self.length)
        _, self.one, which = np.unique(np.stack([key, self.length.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        pair = np.unique(np.stack([which.reshape(-1), same[self.item]], 1), axis=0)
        pair = pair[[self.ids[i] is not None for i in pair[:, 1]]] if len(pair) else pair
        self.has, self.items = np.searchsorted(pair[:, 0], np.arange(len(self.one) + 1)), pair[:, 1]
        self.single = np.unique(self.hash[self.start[self.length == 1]])
        self.pair = np.unique(_pairs(self.hash)[self.start[self.length > 1]])
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.pair & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True


def _pairs(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        out[:-1] = W.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return out


def _sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums of word hashes times powers, from which the hash of any run of words follows."""
    up, _ = W._POWERS.upto(len(h))
    out = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[: len(h)], out=out[1:])
    return out


def _run(sums: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hash of the `length` words from each position."""
    _, down = W._POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        return (sums[at + length] - sums[at]) * down[at]


class Shard:
    """The suffix array of a run of documents: word positions in the order of the words that follow, as far as `depth` words."""

    def __init__(self, w: W.Words, test: TestSet, depth: int):
        self.hash, self.first, self.doc, self.sums = w.hash, w.first, w.doc(), _sums(w.hash)
        self.last = np.repeat(w.first[1:], w.count)
        pair = _pairs(w.hash)
        maybe = np.flatnonzero(test.filter[(pair & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        maybe = maybe[(maybe + 1 < self.last[maybe]) & np.isin(pair[maybe], test.pair)]
        if len(test.single):
            maybe = np.union1d(maybe, np.flatnonzero(np.isin(w.hash, test.single)))
        self.sa = maybe if len(maybe) < 2 else self._doubled(maybe, depth) if depth > SHALLOW else self._refined(maybe, depth)

    def word(self, at: np.ndarray, depth) -> np.ndarray:
        """The word `depth` after a position; 0, before all words, past the text's end."""
        to = at + depth
        return np.where(to < self.last[at], self.hash[np.minimum(to, len(self.hash) - 1)], np.uint64(0))

    def _refined(self, at: np.ndarray, depth: int) -> np.ndarray:
        """A few words are looked at one by one, each only where the wanted suffixes tie so far."""
        sa, rank, open_ = at[np.argsort(self.hash[at], kind="stable")], np.zeros(len(at), np.int64), np.arange(len(at))
        key = self.hash[sa]
        for d in range(1, depth + 1):
            fresh = np.ones(len(open_), bool)
            fresh[1:] = (rank[open_][1:] != rank[open_][:-1]) | (key[1:] != key[:-1])
            rank[open_] = open_[fresh][np.cumsum(fresh) - 1]
            tie = ~fresh
            tie[:-1] |= ~fresh[1:]
            open_ = open_[tie & (self.last[sa[open_]] > sa[open_] + d - 1)]
            if d == depth or not len(open_):
                break
            key = self.word(sa[open_], d)
            order = np.lexsort((key, rank[open_]))
            sa[open_], key = sa[open_][order], key[order]
        return sa

    def _doubled(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Prefix doubling: ranks by d words give ranks by 2 d, until no two of the wanted suffixes tie or `depth` is reached."""
        rank = np.unique(self.hash, return_inverse=True)[1].reshape(-1) + 1
        d, places = 1, np.arange(len(rank))
        while d < depth and len(np.unique(rank[at])) < len(at):
            to = places + d
            after = np.where(to < self.last, rank[np.minimum(to, len(rank) - 1)], 0)
            order = np.lexsort((after, rank))
            step = np.ones(len(rank), np.int64)
            step[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
            rank[order] = np.cumsum(step)
            d *= 2
        return at[np.argsort(rank[at], kind="stable")]

    def _common(self, at: np.ndarray, test: TestSet, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that suffixes `at` and test suffixes `q` have in common, up to `most`: steps of doubled length forward, then of halved length."""
        most = np.minimum(most, self.last[at] - at)
        out = np.zeros(len(at), np.int64)
        go = np.flatnonzero(most > 0)
        go = go[self.hash[at[go]] == test.hash[test.start[q[go]]]]
        out[go] = 1
        step, open_ = np.ones(len(at), np.int64), go
        while len(go):  # equal so far: twice as far
            far = np.minimum(2 * out[go], most[go])
            equal = (far > out[go]) & (_run(self.sums, at[go], far) == _run(test.sums, test.start[q[go]], far))
            step[go] = far
            go = go[equal]
            out[go] = step[go]
        low, high = out[open_], np.maximum(out[open_], step[open_] - 1)
        high = np.where(step[open_] == out[open_], out[open_], high)
        while len(k := np.flatnonzero(low < high)):
            mid = (low[k] + high[k] + 1) // 2
            equal = _run(self.sums, at[open_[k]], mid) == _run(test.sums, test.start[q[open_[k]]], mid)
            low[k], high[k] = np.where(equal, mid, low[k]), np.where(equal, high[k], mid - 1)
        out[open_] = low
        return out

    def bound(self, test: TestSet, q: np.ndarray, most: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of all test suffixes at once, by their first `most` words."""
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(self.sa), np.int64)
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) // 2
            at = self.sa[mid]
            c = self._common(at, test, q[go], most[go])
            equal = c == most[go]
            ours = test.hash[np.minimum(test.start[q[go]] + c, len(test.hash) - 1)]
            less = np.where(equal, upper, self.word(at, c) < ours)
            low[go] = np.where(less, mid + 1, low[go])
            high[go] = np.where(less, high[go], mid)
        return low

    def occurrences(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """(word position, distinct window) of each occurrence of a window: of each length, one window at most begins at a position."""
        q = test.one
        if not len(self.sa) or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self.bound(test, q, test.length[q], False)
        # most windows are nowhere: only those that the lower bound meets have an interval
        here = np.flatnonzero(low < len(self.sa))
        here = here[self._common(self.sa[low[here]], test, q[here], test.length[q[here]]) == test.length[q[here]]]
        q, low = q[here], low[here]
        n = self.bound(test, q, test.length[q], True) - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.sa[at], np.repeat(here, n)

    def longest(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """Of each test suffix: the length of its longest match in the shard, and where it is."""
        q = np.arange(len(test.start))
        whole = test.end - test.start
        best, place = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        if len(self.sa):
            ins = self.bound(test, q, whole, False)
            for near in (ins - 1, ins):
                ok = np.flatnonzero((near >= 0) & (near < len(self.sa)))
                c = self._common(self.sa[near[ok]], test, q[ok], whole[ok])
                more = c > best[ok]
                best[ok[more]], place[ok[more]] = c[more], self.sa[near[ok[more]]]
        return best, place


def _hits(test, uid: bool):
    def run(batches):
        t: TestSet = test.value
        for b in W.chunks(batches, "text", SHARD_BYTES):
            w = W.split(b.column(1), W.ALNUM, lower=True)
            at, own = Shard(w, t, t.window).occurrences(t)
            docs = b.num_rows
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + t.length[t.one[own]], -1)
            hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
            # a span ends where its document does, whatever the next one begins with
            begin, stop = np.flatnonzero((hit[1:-1] > 0) & ((hit[:-2] == 0) | _starts(w))), np.flatnonzero((hit[1:-1] > 0) & ((hit[2:] == 0) | _stops(w))) + 1
            doc = w.doc()
            spans = np.searchsorted(doc[begin], np.arange(docs + 1)) if len(begin) else np.zeros(docs + 1, np.int64)
            base = w.first[doc[begin]]
            met = np.unique(np.stack([doc[at], own], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            n = t.has[met[:, 1] + 1] - t.has[met[:, 1]]  # the items of each window that a document has
            each = np.repeat(t.has[met[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = np.unique(np.stack([np.repeat(met[:, 0], n), t.items[each]], 1), axis=0)
            items = np.searchsorted(found[:, 0], np.arange(docs + 1))
            struct = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], ["start", "end"])
            cols = [
                b.column(0), pa.array(w.count), pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), struct),
                pa.ListArray.from_arrays(pa.array(items.astype(np.int32)), pa.array(t.ids[found[:, 1]].tolist(), pa.string())),
            ]
            names = ["doc_id", "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(cols + b.columns[2:], names + ["uid"] * uid)

    return run


def _starts(w):
    out = np.zeros(len(w.hash), bool)
    out[w.first[:-1][w.count > 0]] = True
    return out


def _stops(w):
    out = np.zeros(len(w.hash), bool)
    out[w.first[1:][w.count > 0] - 1] = True
    return out


def _longest(test):
    def run(batches):
        t: TestSet = test.value
        for b in W.chunks(batches, "text", SHARD_BYTES):
            w = W.split(b.column(1), W.ALNUM, lower=True)
            shard = Shard(w, t, t.depth)
            best, place = shard.longest(t)
            q = np.flatnonzero(best >= t.length)
            doc = shard.doc[place[q]] if len(q) else place[q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.ids[t.item[q]].tolist(), pa.string()), pa.array(t.word[q]), pa.array(best[q]), b.column(0).take(pa.array(doc)), pa.array(place[q] - w.first[doc])],
                ["item_id", "item_word", "length", "doc_id", "doc_word"],
            )

    return run


def _blocks(bench: DataFrame, window: int, id_col: str, text_col: str):
    """Broadcast test sets, each of a bounded part of the benchmark."""
    spark = bench.sparkSession
    rows = bench.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        yield spark.sparkContext.broadcast(TestSet([r.i for r in part], [r.t for r in part], window))


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges inside occurrences of a test window, merged) and items (distinct test items with an occurring window, as strings).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is `window`
    consecutive words of an item; an item of fewer words is one window, one without words has none. Null
    texts have no words; a test row with a null id still marks words but is no item; test rows of one id are one item. Repeated
    documents each have their row. Other columns are not read, whatever their names; an empty benchmark marks nothing.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    tests = list(_blocks(bench, window, item_col, item_text))
    if len(tests) == 1:
        return texts.mapInArrow(_hits(tests[0], False), schema)
    work = Work(docs.sparkSession, "decontaminate")
    named = work.write(texts.withColumn("uid", F.monotonically_increasing_id()), "named")  # written, so that all scans see one numbering
    out = None
    for t in tests:
        part = work.write(named.mapInArrow(_hits(t, True), schema + ", uid bigint"), "part")
        out = part if out is None else out.union(part)
    merged = out.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = "cast(array() as array<struct<start:bigint,end:bigint>>)"
    joined = f"aggregate(all, {none}, (a, x) -> case when size(a) > 0 and element_at(a, -1).end >= x.start then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))) else concat(a, array(x)) end)"
    return merged.selectExpr("doc_id", "n_words", f"{joined} as spans", "items")


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim match of every test suffix that matches at least its window: item_id, item_word (where the suffix starts), length in words, and the doc_id and doc_word of the match (of equals, the smallest). Nulls, repeated rows and empty tables as in `contamination`."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"item_id string, item_word bigint, length bigint, doc_id {dict(texts.dtypes)['doc_id']}, doc_word bigint"
    out = None
    for t in _blocks(bench, window, item_col, item_text):
        part = texts.mapInArrow(_longest(t), schema)
        out = part if out is None else out.union(part)
    best = out.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_word")).alias("m"))
    return best.select("item_id", "item_word", (-F.col("m.less")).alias("length"), F.col("m.doc_id").alias("doc_id"), F.col("m.doc_word").alias("doc_word"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", **columns) -> DataFrame:
    """`docs` without the contaminated documents, all columns kept; a null id is kept. Of rows that repeat an id, all go when one is contaminated."""
    work = Work(docs.sparkSession, "decontaminate")
    bad = work.write(contamination(docs, bench, window, id_col, **columns).where(F.size("spans") > 0).select(F.col("doc_id").alias(id_col)).distinct(), "bad")
    return join_checked(docs, bad, id_col, "left_anti", 16 * bad.count()).select(docs.columns)


def op1_suffix_array_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return contamination(docs, bench).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
