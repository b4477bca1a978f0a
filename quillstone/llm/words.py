"""Vectorised word splitting and hashing over Arrow text columns, used inside Spark tasks.

Words are maximal runs of bytes of a class, which is exact for classes whose non-ASCII part is all
or nothing (UTF-8 lead and trail bytes are >= 0x80). Texts are handled whole; only working arrays
are bounded, by cutting the bytes between words.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
LONG_WORD = 1 << 16
_P = ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _white() -> np.ndarray:
    ok = np.ones(256, bool)
    ok[[0x20, *range(0x09, 0x0E)]] = False
    return ok


def _alnum() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[0x30:0x3A] = ok[0x61:0x7B] = ok[0x80:] = True
    ok[0x41:0x5B] = True
    return ok


#: Word classes: all but white space, and digits, letters and everything beyond ASCII.
WHITE, ALNUM = _white(), _alnum()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                base = np.full(n + 1, _P, np.uint64)
                base[0] = 1
                self.up = np.multiply.accumulate(base)
                base[1:] = np.uint64(pow(int(_P), -1, 1 << 64))
                self.down = np.multiply.accumulate(base)
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """The words of some texts: byte ranges (start, end), 64-bit hashes, and the first word of each text (`first`, one longer than the texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, start, end, hashes, first):
        self.data, self.offsets, self.start, self.end, self.hash, self.first = data, offsets, start, end, hashes, first

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word (of all, if fewer)."""
        out = np.full(len(self.start), n, np.uint64)
        if len(out):
            with np.errstate(over="ignore"):
                for j in range(n):
                    at = self.start + j
                    byte = np.where(at < self.end, self.data[np.minimum(at, len(self.data) - 1)], 0).astype(np.uint64)
                    out = out * _P + byte
        return mix(out)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind, none = (pa.large_binary(), b"") if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else (pa.large_string(), "")
    texts = pc.fill_null(texts.cast(kind), none)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def split(texts, cls: np.ndarray = WHITE, lower: bool = False, hashes: bool = True, cuts=None) -> Words:
    """cuts: of the bytes (lower-cased, if asked), the places where words are cut as well."""
    data, off = bytes_of(texts)
    if lower:
        data = np.frombuffer(data.tobytes().translate(LOWER.tobytes()), np.uint8)
    table = cls.astype(np.uint8).tobytes()
    n, starts, ends, hs, at = len(data), [], [], [], 0
    cut = np.zeros(n + 1, bool)
    cut[off] = True  # texts never share a word
    if cuts is not None:
        cut[cuts(data)] = True
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n:
            for low in (max(at, to - 4096), at):
                if len(gaps := np.flatnonzero(~cls[data[low:to]] | cut[low + 1 : to + 1])):
                    to = low + int(gaps[-1]) + 1
                    break
            while not len(gaps) and to < n:
                step = min(n, to + SEGMENT)
                gaps = np.flatnonzero(~cls[data[to:step]] | cut[to + 1 : step + 1])
                to = to + int(gaps[0]) + 1 if len(gaps) else step
        part = data[at:to]
        ok = np.frombuffer(part.tobytes().translate(table), bool)
        begin, stop = ok.copy(), ok.copy()
        begin[1:] &= ~ok[:-1] | cut[at + 1 : to]
        stop[:-1] &= ~ok[1:] | cut[at + 1 : to]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if hashes and len(s):
            hs.append(_hash(part, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = cat(starts, np.int64)
    return Words(data, off, start, cat(ends, np.int64), cat(hs, np.uint64), np.searchsorted(start, off))


def _hash(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    long = np.flatnonzero(e - s > LONG_WORD)
    if len(part) > 4 * SEGMENT:  # one immense word
        h = np.zeros(len(s), np.uint64)
    else:
        up, down = _POWERS.upto(len(part))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(part[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * _P) | np.uint64(1)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position, and whether all k are in one text (elsewhere the hash means nothing)."""
    n = len(w.hash)
    last = np.repeat(w.first[1:], w.count)
    ok = np.arange(n) + k <= last
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(_weights(k)):
            if j < n:
                out[: n - j] += w.hash[j:] * c
    return mix(out), ok


def long_windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), by prefix sums: its cost does not depend on k."""
    n = len(w.hash)
    ok = np.arange(n) + k <= np.repeat(w.first[1:], w.count)
    out = np.zeros(n, np.uint64)
    for a in range(0, n, SEGMENT):
        b = min(n, a + SEGMENT + k)
        up, down = _POWERS.upto(b - a)
        with np.errstate(over="ignore"):
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(w.hash[a:b] * up[: b - a], out=sums[1:])
            m = max(0, min(SEGMENT, b - a - k + 1))
            out[a : a + m] = mix((sums[k : k + m] - sums[:m]) * down[:m] + np.uint64(k))
    return out, ok


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, ascending, and the first of each text; fewer words make one shingle, none make none."""
    g, ok = windows(w, k)
    n, first = w.count, w.first
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        acc = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for j, c in enumerate(_weights(k)):
                at = np.minimum(first[few] + j, len(w.hash) - 1)
                acc += np.where(j < n[few], w.hash[at] * c, np.uint64(0))
            g[first[few]] = mix(acc + n[few].astype(np.uint64) * _P)
        ok[first[few]] = True
    g = g[ok]
    ends = np.concatenate([[0], np.cumsum(np.where(n >= k, n - k + 1, (n > 0)))]).astype(np.int64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    keep[ends[:-1][ends[:-1] < len(g)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return g[keep], total[ends]


def _frugal() -> None:
    """Large arrays go back to the system when they are freed, not at a task's end: two workers share with the executor's heap what memory it has."""
    pa.set_memory_pool(pa.system_memory_pool())
    if set_ := getattr(ctypes.CDLL(None), "mallopt", None):
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 2)):  # glibc: mapped from this size on, trimmed beyond this, arenas
            set_(option, value)


_frugal()


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and would hold it while others run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(batches, text: str, most: int = 2 << 20):
    """Record batches cut into runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    try:
        yield from _chunks(batches, text, most)
    finally:
        give_back()


def _chunks(batches, text: str, most: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        _, off = bytes_of(batch.column(at))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
