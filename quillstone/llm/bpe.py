"""Operator 12, byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that byte-pair encoding makes. It starts as one
state with a loop for every byte. Each merge (a, b) -> c, in order, is a gadget: what a leads to is replaced by a copy
without its arc b (only a, or whatever else shares the state, keeps the old one), and every state that has an arc a
gets an arc c to where b leads. All arcs of one label lead to one state, so a state is a set of arcs that merges
took away, each with the merge's rank, and an arc c is there if its left part a was when c was made: the
tables are `target` (label -> state), `gone` (state and label -> rank) and each label's left part and rank.

A word is encoded by the one path of labels that spells it. Every prefix of a word has such a path, and its last label is known
once those of shorter prefixes are; so a sweep over the ends of labels in a word, for all words at once, takes
at each end the one label that has an arc from the state before it. Decoding emits the labels of arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

from .batches import extended

#: Distinct words whose ids a worker keeps before it starts over, and characters of text whose words are held at once.
KNOWN_WORDS, HELD_CHARS = 1 << 18, 1 << 20
#: Characters from which on a word is encoded by itself.
LONG_WORD = 200
_NEVER = 1 << 30


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in files of byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _classes(split) -> dict[str, list[tuple[int, int]]]:
    """Ranges of letters (a), numbers (1), white space and the rest (!) as the tokenizer's own splitter knows them: versions of Unicode differ."""
    points = "".join(map(chr, chain(range(0x20), range(0x21, 0xD800), range(0xE000, 0x110000))))
    found = {"a": [], "1": [], "!": [], " ": [(0x20, 0x20)]}
    for _, (s, e) in split(points):  # runs of one class
        kind = next((k for k in "a1!" if len(split(k + points[s])) == 1), " ")
        found[kind].append((ord(points[s]), ord(points[e - 1])))
    return found


def splitter(classes: dict[str, list[tuple[int, int]]], below: int = 0x110000) -> tuple[re.Pattern, re.Pattern]:
    """What matches words of texts without code points from `below` on (fewer ranges match faster), and where white space begins."""
    a, n, s = ("".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in classes[k] if x < below) for k in "a1 ")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+"), re.compile(f"(?<=[^{s}])(?=[{s}])")


class Automaton:
    """Tables of the automaton that a byte-level BPE file's merges compile to, with its splitter. Plain arrays of a few MB: tasks get them with the function."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE files are compiled")
        if odd := [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]:
            raise ValueError(f"{path}: added tokens that take in or need what surrounds them: {odd}")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        signs = _byte_signs()
        of = model["vocab"]
        n = max([*of.values(), *self.specials.values()]) + 1
        self.labels = [b""] * n
        for token, i in of.items():
            self.labels[i] = bytes(signs[c] for c in token)
        for token, i in self.specials.items():
            self.labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._spell(self._compile(n, [of[s] for s in signs], [(of[a], of[b], of[a + b]) for a, b in pairs]))
        self.classes = _classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)

    def _compile(self, n: int, alphabet: list[int], merges: list[tuple[int, int, int]]) -> list[int]:
        """Applies all gadgets; gives the labels that have arcs. A merge whose parts never meet has no effect."""
        gone: list[dict[int, int]] = [{}]  # of each state, the arcs taken away and the ranks that took them
        users = [1 + len(alphabet)]  # labels that lead to a state; the start needs the first as well
        target = np.zeros(n, np.int64)
        self.left, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        used = set(alphabet)

        def has(state: int, label: int) -> bool:
            made = _NEVER
            while label >= 0:
                if gone[state].get(label, _NEVER + 1) <= made:
                    return False
                made, label = self.rank[label], self.left[label]
            return True

        for r, (a, b, c) in enumerate(merges):
            state = target[a]
            if a not in used or b not in used or not has(state, b):
                continue
            used.add(c)
            self.left[c], self.rank[c], target[c] = a, r, target[b]
            users[target[b]] += 1
            if users[state] > 1:
                users[state] -= 1
                target[a] = len(gone)
                gone.append(dict(gone[state]))
                users.append(1)
            gone[target[a]].setdefault(b, r)
        self.target = target
        keys = np.array([s << 32 | b for s, d in enumerate(gone) for b in d], np.int64)
        ranks = np.array([r for d in gone for r in d.values()], np.int64)
        order = np.argsort(keys)
        self.gone, self.gone_rank = keys[order], ranks[order]
        return sorted(used)

    def _spell(self, tokens: list[int]) -> None:
        """A trie of the labels' bytes: (node, byte) -> node, and the token that ends at a node."""
        node, token = {}, [-1]
        for t in tokens:
            at = 0
            for byte in self.labels[t]:
                key = at << 8 | byte
                if key not in node:
                    node[key] = len(token)
                    token.append(-1)
                at = node[key]
            token[at] = t
        self.step = np.array(sorted(node), np.int64)
        self.child = np.array([node[k] for k in sorted(node)], np.int64)
        self.token = np.array(token, np.int64)

    def follows(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether a state has an arc: neither the label was taken away, nor its left part before the label was made, nor that one's."""
        ok = np.ones(len(state), bool)
        live, made = np.arange(len(state)), np.full(len(state), _NEVER)
        while len(live):
            key = state[live] << 32 | label
            at = np.minimum(np.searchsorted(self.gone, key), len(self.gone) - 1)
            dead = (self.gone[at] == key) & (self.gone_rank[at] <= made) if len(self.gone) else np.zeros(len(live), bool)
            ok[live[dead]] = False
            on = ~dead & (self.left[label] >= 0)
            live, made, label = live[on], self.rank[label[on]], self.left[label[on]]
        return ok

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)"""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        begin, until = np.repeat(stop - size, size), np.repeat(stop, size)
        start, node, k, arcs = np.arange(len(data)), np.zeros(len(data), np.int64), 0, []
        while len(start) and len(self.step):
            key = node << 8 | data[start + k]
            at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            hit = self.step[at] == key
            start, node, k = start[hit], self.child[at[hit]], k + 1
            token = self.token[node]
            arcs.append((start[token >= 0], np.full(np.count_nonzero(token >= 0), k), token[token >= 0]))
            on = start + k < until[start]
            start, node = start[on], node[on]
        start, long, token = (np.concatenate(x) if arcs else np.zeros(0, np.int64) for x in (list(zip(*arcs, strict=True)) or [()] * 3))
        depth = start + long - begin[start]
        order = np.argsort(depth, kind="stable")
        start, long, token = start[order], long[order], token[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(depth))]) if len(depth) else [0]
        last, span = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            s, t = start[a:b], token[a:b]
            first = s == begin[s]
            ok = self.follows(np.where(first, 0, self.target[last[s - 1]]), t)
            end = s[ok] + long[a:b][ok] - 1
            last[end], span[end] = t[ok], long[a:b][ok]
        on_path, at = np.zeros(len(data), bool), stop[size > 0] - 1
        low = begin[at]
        while len(at):
            on_path[at] = True
            at = at - span[at]
            at, low = at[at >= low], low[at >= low]
        which = np.repeat(np.arange(len(words)), size)
        return last[on_path], np.bincount(which[on_path], minlength=len(words))

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one word, by the same sweep without arrays: for words so long that few others keep step with them."""
        if not hasattr(self, "_steps"):
            self._steps, self._gone = dict(zip(self.step.tolist(), self.child.tolist(), strict=True)), dict(zip(self.gone.tolist(), self.gone_rank.tolist(), strict=True))
        step, gone, token, left, rank, target = self._steps, self._gone, self.token.tolist(), self.left.tolist(), self.rank.tolist(), self.target.tolist()
        last, came = array("i", [-1]) * (len(word) + 1), array("q", [0]) * (len(word) + 1)
        for s in range(len(word)):
            state, node = (target[last[s]] if s else 0) << 32, 0
            for e in range(s, len(word)):
                node = step.get(node << 8 | word[e])
                if node is None:
                    break
                label = t = token[node]
                if t >= 0 > last[e + 1]:
                    made = _NEVER
                    while label >= 0 and gone.get(state | label, _NEVER + 1) > made:
                        made, label = rank[label], left[label]
                    if label < 0:
                        last[e + 1], came[e + 1] = t, s
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = came[at]
        return out[::-1]


def spelled(labels: list[bytes], ids: np.ndarray) -> str:
    """Labels of ids, one after the other; ids without a label are passed over, bytes that are no UTF-8 are U+FFFD."""
    return b"".join(map(labels.__getitem__, ids[ids < len(labels)].tolist())).decode("utf-8", "replace")


class Encoder:
    """An automaton in a worker, with the words it has met."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.known = automaton, {}
        self.splitters = [(chr(below - 1), *splitter(automaton.classes, below)) for below in (0x80, 0x10000, 0x110000)]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.specials, key=len, reverse=True))) + ")") if automaton.specials else None

    def parts(self, text: str):
        """Lists of words of runs of a text; added tokens, as 1-tuples, split it first. Runs end where white space begins, which no word spans."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield [(part,)], len(part)
                continue
            at, top = 0, "" if part.isascii() else max(part)
            _, words, white = next(s for s in self.splitters if top <= s[0])
            while at < len(part):
                cut = white.search(part, at + HELD_CHARS) if at + HELD_CHARS < len(part) else None
                to = cut.start() if cut else len(part)
                yield words.findall(part[at:to]), to - at
                at = to

    def learn(self, held: list) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self.known |= {(s,): i.to_bytes(4, "little") for s, i in self.automaton.specials.items()}
        new = list(set(chain.from_iterable(w for _, w in held)) - self.known.keys())
        self.known |= {w: np.array(self.automaton.encode_long(w.encode()), "<u4").tobytes() for w in new if len(w) > LONG_WORD}
        new = [w for w in new if len(w) <= LONG_WORD]
        for a in range(0, len(new), 1 << 14):
            own = new[a : a + (1 << 14)]
            ids, size = self.automaton.encode([w.encode() for w in own])
            blob, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
            self.known.update(zip(own, (blob[x:y] for x, y in zip([0, *ends], ends)), strict=True))

    def ids(self, texts) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, held, chars = [bytearray() for _ in texts], [], 0

        def flush():
            self.learn(held)
            for row, words in held:
                out[row] += b"".join(map(self.known.__getitem__, words))
            held.clear()

        for row, text in enumerate(texts):
            for words, n in self.parts(text or ""):
                held.append((row, words))
                chars += n
                if chars >= HELD_CHARS:
                    flush()
                    chars = 0
        flush()
        return [bytes(x) for x in out]


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Adds each whole text's token ids, as the file's tokenizer makes them without special tokens around, as little-endian 32-bit integers in a binary.

    Added tokens in a text are one id, as there. Null and empty texts have no ids (an empty binary). Rows are judged each, repeated ones too; a
    column named `into` is replaced, all others stay; an empty table stays empty. The file is read on the driver alone.
    """
    automaton = Automaton(path)

    def start():
        encoder = _ENCODERS.setdefault(path, Encoder(automaton))
        return lambda b: [pa.array(encoder.ids(b.column(0).to_pylist()), pa.binary())]

    return extended(docs, {text_col: "string"}, [StructField(into, BinaryType())], start)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of token ids, special tokens included. Null ids give an empty text, ids outside the vocabulary none; a column named `into` is replaced."""
    labels = Automaton(path).labels

    def start():
        return lambda b: [pa.array([spelled(labels, np.frombuffer(x or b"", "<u4")) for x in b.column(0).to_pylist()], pa.string())]

    return extended(rows, {ids_col: "binary"}, [StructField(into, StringType())], start)


def count_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")


def op12_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and the text they decode to; null and empty texts have none, of repeated rows each is encoded, an empty table gives none, further columns are passed over."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = decode(encode(docs, path).select("doc_id", "ids"), path)
    return rows.select("doc_id", count_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
