"""Operator 8, bulk-synchronous best-fit packing.

Documents are tokenised and cut into pieces of at most the capacity. A superstep range-sorts the pieces
still to place by length, the longest first, and the gaps of the sequences so far by size, and deals
both by rank to lanes, so that every lane has the same mix of lengths and no two lanes meet over a piece or a
gap. Each lane, a task of bounded size, sweeps its pieces from the longest run of equal lengths on: a run
goes to its successor, the smallest run of gaps that holds it; of a run's pieces the k-th by rank takes the
k-th gap, as many as that holds; the gaps are updated, and what finds none opens sequences. At the end of
a superstep every lane gives back the pieces of its emptiest new sequence; these, and as many of the lane's updated
gaps, are the rows of the next, with a sixteenth of the lanes, until one lane is left, which places all.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Work

#: Pieces that a lane takes, about, and how many lanes one lane of the next superstep follows.
LANE_PIECES, LANES_EACH = 1 << 17, 16
#: Distinct words whose ids a task keeps before it starts over.
CACHE_WORDS = 3 << 17
#: Words encoded at once: each alone, or joined to one text.
ENCODE_WORDS, JOIN_WORDS = 4096, 16384
#: Lower-case ASCII and Latin-1 letters: always one word to the tokenizer.
_PLAIN = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")


_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_OTHER[0x21:0x7F] = True
_OTHER &= ~_LETTER


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Places between an ASCII letter and another ASCII sign, inside words without an apostrophe or `<`: the tokenizer splits there whatever surrounds them (contractions and special tokens need the others)."""
    letter, other = _LETTER[data], _OTHER[data]
    at = np.flatnonzero((letter[:-1] & other[1:]) | (other[:-1] & letter[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    odd = np.flatnonzero((data == 0x27) | (data == 0x3C))
    if len(odd) and len(at):
        white = np.concatenate([[-1], np.flatnonzero(~W.WHITE[data]), [len(data)]])
        at = at[~np.isin(np.searchsorted(white, at), np.searchsorted(white, odd))]
    return at


class WordTokens:
    """Token ids by a tokenizer that lower-cases, drops white space, never joins across it, and splits words from punctuation: each distinct word part is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.final = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.final[i] = token.endswith("</w>")
        self.clear()

    def clear(self):
        self.known, self.at, self.size, self.flat, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def parts(self, texts) -> W.Words:
        return W.split(texts, lower=True, cuts=word_cuts)

    def _encode(self, words: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Plain words are one piece of the vocabulary's word-end kind each, so many of them are encoded as one text."""
        texts = [b" ".join(words).decode()] if plain else [x.decode("utf-8", "replace") for x in words]
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((x for f in found for x in f), np.uint32, sum(map(len, found)))
        if not plain:
            return flat, np.fromiter(map(len, found), np.int64, len(found))
        ends = np.flatnonzero(self.final[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not mark the end of every word")
        return flat, np.diff(np.concatenate([[0], ends]))

    def _add(self, keys: np.ndarray, words: list[bytes], plain: bool) -> None:
        flat, size = self._encode(words, plain)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(keys)
        to = np.searchsorted(self.known, keys[order])
        self.known, self.at, self.size = np.insert(self.known, to, keys[order]), np.insert(self.at, to, at[order]), np.insert(self.size, to, size[order])

    def ids(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all word parts in turn, number of ids of each)"""
        which, keys = pd.factorize(w.hash)
        one = np.zeros(len(keys), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.known) > CACHE_WORDS:
            self.clear()
        new = one[~np.isin(keys, self.known, assume_unique=True)]
        words = [w.raw(i) for i in new]
        plain = np.fromiter((_PLAIN.fullmatch(x) is not None for x in words), bool, len(new))
        for kind, step in ((True, JOIN_WORDS), (False, ENCODE_WORDS)):
            part = np.flatnonzero(plain == kind)
            for a in range(0, len(part), step):
                own = part[a : a + step]
                self._add(w.hash[new[own]], [words[i] for i in own], kind)
        place = np.searchsorted(self.known, keys)[which]
        size = self.size[place]
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[place] - (ends - size), size)
        return self.flat[index], size


_TOKENS: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One for each worker process, so that tasks share what earlier ones have encoded."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        tokens = tokens_of(path)
        for b in W.chunks(batches, "text"):
            w = tokens.parts(b.column(1))
            ids, size = tokens.ids(w)
            per = np.concatenate([[0], np.cumsum(size)])[w.first]
            row, piece, start, length, crc = [], [], [], [], []
            tail = np.array([end_id], "<u4")
            for d, (x, y) in enumerate(zip(per[:-1], per[1:], strict=True)):
                own = np.concatenate([ids[x:y], tail]).astype("<u4", copy=False)
                for p, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    row.append(d)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            doc = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fit(counts: dict[int, int], capacity: int, open_gaps: dict[int, list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], int]:
    """The sweeps of a lane. counts: pieces of each length; open_gaps: of each gap, runs of sequences (first, how many), of negative numbers.

    Gives rows (length, first rank, pieces, pieces to a sequence, first sequence, gap before), the gaps left in the same form, and how many sequences were opened (from 0)."""
    gaps = {g: list(runs) for g, runs in (open_gaps or {}).items()}
    sizes = sorted(gaps)  # the gaps, ascending
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[i]
            else:
                gap, n = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + n
            each = gap // length
            full = min(n, left // each)
            taken = full * each
            if full:
                plan.append((length, rank, taken, each, first, gap))
                put(gap - each * length, first, full)
            if full < n and left > taken:  # the last sequence of the run takes what remains
                plan.append((length, rank + taken, left - taken, left - taken, first + full, gap))
                put(gap - (left - taken) * length, first + full, 1)
                full, taken = full + 1, left
            put(gap, first + full, n - full)
            rank, left = rank + taken, left - taken
    return np.array(plan, np.int64).reshape(-1, 6), gaps, opened


_STATE = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
#: Kinds of rows between supersteps: a piece to place, a placed one, and a gap (its size as length).
_FREE, _PLACED, _GAP = 0, 1, 2


def _lane(capacity: int, step: int, last: bool):
    """A lane's superstep. Sequences are numbered by superstep, lane and order."""

    def run(key, table):
        kind, length, ids = (table.column(c).to_numpy() for c in ("kind", "length", "sequence_id"))
        base = (step << 56) + (key[0].as_py() << 32)
        own = np.flatnonzero(kind == _GAP)
        own = own[np.lexsort((ids[own], length[own]))]
        runs: dict[int, list[tuple[int, int]]] = {}
        for g, at, n in zip(*(x.tolist() for x in np.unique(length[own], return_index=True, return_counts=True)), strict=True):
            runs[g] = [(at - len(own), n)]  # the k-th of the sorted gaps is sequence k - len
        pieces = np.flatnonzero(kind == _FREE)
        rank = {c: table.column(c).take(pa.array(pieces)).to_pandas() for c in ("doc_id", "piece", "ids_crc32")}
        pieces = pieces[pd.DataFrame({"n": -length[pieces], **rank}).sort_values(["n", "doc_id", "piece", "ids_crc32"], kind="stable").index.to_numpy()]
        sizes, at, counts = np.unique(-length[pieces], return_index=True, return_counts=True)
        plan, left, opened = fit(dict(zip((-sizes).tolist(), counts.tolist(), strict=True)), capacity, runs)
        first = dict(zip((-sizes).tolist(), at.tolist(), strict=True))
        sequence, offset = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for n, r, many, each, seq, gap in plan.tolist():
            k = np.arange(many)
            to = slice(first[n] + r, first[n] + r + many)
            sequence[to], offset[to] = seq + k // each, capacity - gap + k % each * n
        back = -(1 << 40)
        if not last and (new := {g: [x for x in runs if x[0] >= 0] for g, runs in left.items()}):
            widest = max((g for g, runs in new.items() if runs), default=None)
            back = new[widest][-1][0] + new[widest][-1][1] - 1 if widest is not None else back
        number = lambda s: np.where(s < 0, ids[own][np.minimum(s + len(own), len(own) - 1)] if len(own) else s, base + s)
        free = sequence == back
        placed = table.take(pa.array(pieces))
        put = lambda t, c, v: t.set_column(t.schema.get_field_index(c), c, pa.array(v))
        placed = put(put(put(placed, "kind", np.where(free, _FREE, _PLACED).astype(np.int32)), "sequence_id", np.where(free, 0, number(sequence))), "offset", np.where(free, 0, offset))
        # a returned piece needs one gap at most: the largest ones go on
        gap = [(g, s) for g in sorted(left, reverse=True) for at, n in left[g] for s in range(at, at + n) if s != back] if free.any() else []
        gap = gap[: int(free.sum())]
        sizes, ids_ = (np.array([x[i] for x in gap], np.int64) for i in (0, 1))
        rest = pa.table({c: pa.nulls(len(gap), placed.schema.field(c).type) for c in placed.schema.names})
        rest = put(put(put(rest, "kind", np.full(len(gap), _GAP, np.int32)), "length", sizes), "sequence_id", number(ids_))
        rest = rest.set_column(rest.schema.get_field_index("doc_id"), placed.schema.field("doc_id"), pa.nulls(len(gap), placed.schema.field("doc_id").type))
        return pa.concat_tables([placed, rest.cast(placed.schema)]).drop_columns(["lane"])

    return run


def _dealt(work: Work, rows: DataFrame, lanes: int) -> DataFrame:
    """`rows` range-sorted by kind and length, with lane: the rank in that order modulo `lanes`."""
    order = [F.col("kind"), F.desc("length"), F.xxhash64("doc_id", "piece", "ids_crc32", "sequence_id")]
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = work.write(ranged.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("pos")), "ranged")
    before, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").agg(F.count("*")).collect())):  # a number for each partition
        before.append((part, total))
        total += n
    sums = work.spark.createDataFrame(before, "part bigint, before bigint")
    return ranged.join(F.broadcast(sums), "part").withColumn("lane", ((F.col("pos") + F.col("before")) % lanes).cast("int")).drop("part", "pos", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: a tokenizers JSON file, readable on every worker, that lower-cases, drops white space and
    splits words from punctuation. Each document is its ids and then `end_id`, so a null or empty text is one token. Only
    documents over the capacity are cut. Repeated rows and rows with a null id are packed like any
    other. Other columns are not read, whatever their names; an empty table packs nothing.
    """
    work = Work(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    cut = work.write(texts.mapInArrow(_pieces(tokenizer, capacity, end_id), schema), "cut")
    schema += ", kind int, sequence_id bigint, offset bigint"
    zero = F.lit(0).cast("bigint")
    # whole pieces of the capacity are sequences by themselves
    state = cut.select("*", F.lit(_FREE).alias("kind"), zero.alias("sequence_id"), zero.alias("offset"))
    lanes, step, out = max(1, -(-cut.count() // LANE_PIECES)), 0, None
    while True:
        dealt = _dealt(work, state, lanes)
        moved = work.write(dealt.groupBy("lane").applyInArrow(_lane(capacity, step, lanes == 1), schema), "moved")
        placed = moved.where(F.col("kind") == _PLACED).select(*_STATE)
        out = placed if out is None else out.union(placed)
        if lanes == 1:
            work.remove("cut", "ranged")
            return out
        state = moved.where(F.col("kind") != _PLACED)
        lanes, step = -(-lanes // LANES_EACH), step + 1


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
