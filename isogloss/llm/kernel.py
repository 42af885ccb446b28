"""Vectorised text arithmetic on Arrow string columns, used inside tasks.

Texts of a record batch lie in one UTF-8 buffer. The functions here work on
chunks of that buffer (about CHUNK bytes, whole documents) with numpy, so that
memory stays bounded however many or long the documents are, and no step runs
once per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for lo, hi in spans:
        lut[lo : hi + 1] = True
    return lut


#: Bytes of words between ASCII blanks.
NOT_BLANK = ~byte_set((0x09, 0x0D), (0x20, 0x20))
#: Bytes of words of letters and digits, after lower-casing; all non-ASCII counts.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi, their bytes, and their offsets in these; a null is empty."""
    arr = col.cast(pa.large_string()).fill_null("")
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in lut, never across documents; runs per document."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    inside = lut[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags in each range of offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Grown:
    """A table that is made anew, twice as long or more, when it is too short."""

    def __init__(self, make):
        self.make, self.size, self.table = make, 0, None

    def __call__(self, n: int):
        if n > self.size:
            self.size = 1 << max(16, (n - 1).bit_length())
            self.table = self.make(self.size)
        return self.table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


powers = Grown(_powers)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Roller:
    """Quick 64-bit hashes of byte ranges, by a polynomial modulo 2^64: for places and groups, not to tell texts apart.

    Long texts of a recursive kind (of 1,024 bytes, say) can share a value whatever the base.
    """

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


#: A prime modulus, two bases below it and the values of bytes for each.
_PRIME = U64(2**31 - 1)
_BASES = (0x3C6EF372, 0x1B873593)
_VALUES = np.random.default_rng(20240301).integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)


def _prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    def all_of(base: int) -> np.ndarray:
        out, step = np.ones(1, np.uint64), base
        while len(out) < n:  # twice as many at a time
            out = np.concatenate([out, out * U64(step) % _PRIME])
            step = step * step % int(_PRIME)
        return out.astype(np.uint32)

    return [(all_of(b), all_of(pow(b, -1, int(_PRIME)))) for b in _BASES]


prime_powers = Grown(_prime_powers)


class Hasher:
    """62-bit hashes of any byte ranges of a buffer, from prefix sums of two rolling hashes modulo a prime.

    Two different texts of n bytes share a value with a chance of (n / 2^31)^2
    at most over the bases, however they are made.
    """

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.powers = prime_powers(n + 1)
        self.sums = np.zeros((2, n + 1), np.uint64)
        for sums, values, (up, _) in zip(self.sums, _VALUES, self.powers):
            np.cumsum(values[buf] * up[:n] % _PRIME, out=sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = ((sums[ends] - sums[starts]) % _PRIME * down[starts] % _PRIME for sums, (_, down) in zip(self.sums, self.powers))
        return mix((high << U64(31)) | low)


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """A hash of a sequence of hashes."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h + p) * U64(_BASE)
        h ^= h >> U64(29)
    return mix(h)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it repeats an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _DIGIT = byte_set((0x41, 0x5A)), byte_set((0x30, 0x39))
_PUNCT = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_STOP = np.zeros(256, bool)
_STOP[ord(".")] = True
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: A line break parts lines; runs of other bytes are lines.
_IN_LINE = ~byte_set((0x0A, 0x0A))


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a chunk: words, characters, symbols, lines and repeats."""
    docs = len(off) - 1
    ids = np.arange(docs, dtype=np.uint64)
    starts, ends, n_words = spans(buf, off, NOT_BLANK)
    heads = (buf & 0xC0) != 0x80
    out = {"n_words": n_words, "n_chars": per_doc(heads, off), "word_chars": per_doc(heads & NOT_BLANK[buf], off)}
    for name, lut in (("n_symbols", SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT), ("n_marks", _MARK), ("n_stops", _STOP), ("n_letters", _LETTER)):
        out[name] = per_doc(lut[buf], off)
    h = Hasher(buf)
    words, doc = h(starts, ends), np.repeat(ids, n_words)
    word_off = np.concatenate([[0], np.cumsum(n_words)])
    _, again = repeats(join_hashes(words, doc))
    out["n_distinct"] = n_words - per_doc(again, word_off)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        twice, _ = repeats(join_hashes(words[at], words[at + 1], words[at + 2], doc[at]))
        at = at[twice]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = per_doc(covered, word_off)
    a, b, _ = spans(buf, off, _IN_LINE)
    lines = np.searchsorted(starts, b) > np.searchsorted(starts, a)  # words start in it
    a, b = a[lines], b[lines]
    n_lines = np.diff(np.searchsorted(a, off))
    _, again = repeats(join_hashes(h(a, b), np.repeat(ids, n_lines)))
    out["n_lines"] = n_lines
    out["n_dup_lines"] = per_doc(again, np.concatenate([[0], np.cumsum(n_lines)]))
    return out
