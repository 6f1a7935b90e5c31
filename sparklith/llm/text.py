"""Vectorised words and rolling hashes over Arrow string columns.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``. A word's hash is a polynomial over a random
64-bit value for each byte, from prefix sums, then mixed; so no Python object is made for a word. What takes eight bytes
for a byte of text is held for ``BLOCK`` bytes at a time only, so a very long text takes a few times its own size.

Two words of equal hash count as one word everywhere: among n distinct words that is about n * n / 2**65 pairs of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD1342543DE82EF95
#: Bytes of text worked on at a time; a longer text is a block of its own.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: is it part of a word; its random value; the same with A-Z as a-z."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    exact = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
    lower = exact.copy()
    lower[65:91] = exact[97:123]
    return word, exact, lower


@lru_cache(maxsize=1)
def _punctuation() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


class Words:
    """The words of a block: byte positions ``start``/``end``, ``hash``, and ``bounds``: document i has words bounds[i]:bounds[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        is_word, exact, folded = _bytes()
        n = len(data)
        w = is_word[data]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = w[cut]
        last[cut - 1] = w[cut - 1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self._values = folded if lower else exact
        self._rehash()

    def _rehash(self) -> None:
        start, end = self.start, self.end
        self.hash, i = np.empty(len(start), U64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
            a, z = int(start[i]), int(end[j - 1])
            if z - a <= BLOCK:
                total, inverse = self._sums(a, z)
                h = (total[end[i:j] - a] - total[start[i:j] - a]) * inverse[start[i:j] - a]
            else:  # one word that is longer than a block
                h = sum((self._sums(at, min(at + BLOCK, z))[0][-1:] * U64(pow(BASE, at - a, 1 << 64)) for at in range(a, z, BLOCK)), np.zeros(1, U64))
            self.hash[i:j] = mix(h + (end[i:j] - start[i:j]).astype(U64) * U64(0x2545F4914F6CDD1D))
            i = j

    def _sums(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """(prefix sums of the polynomial over the bytes a to z, inverse powers)."""
        power, inverse = _powers(BASE, z - a + 1)
        total = np.empty(z - a + 1, U64)
        total[0] = 0
        np.cumsum(self._values[self.data[a:z]] * power[: z - a], out=total[1:])
        return total, inverse

    def split_tails(self) -> None:
        """Make the ASCII punctuation that closes a word after an ASCII letter a word of its own, but not in words with ``<``."""
        solid = np.flatnonzero(~_punctuation()[self.data])
        before = np.searchsorted(solid, self.end)  # how many bytes before the end are no marks
        tail = np.maximum(np.where(before > 0, solid[np.maximum(before - 1, 0)] + 1 if len(solid) else 0, 0), self.start)
        letter = self.data[np.maximum(tail - 1, 0)] | 0x20
        angle = np.flatnonzero(self.data == 0x3C)
        cut = (tail > self.start) & (tail < self.end) & (letter >= 97) & (letter <= 122) & (np.searchsorted(angle, self.end) == np.searchsorted(angle, self.start))
        at = np.flatnonzero(cut)
        shift = np.concatenate([[0], np.cumsum(cut)])
        end = self.end.copy()
        end[at] = tail[at]
        self.start, self.end = np.insert(self.start, at + 1, tail[at]), np.insert(end, at + 1, self.end[at])
        self.bounds = self.bounds + shift[self.bounds]
        self._rehash()

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def document(self) -> np.ndarray:
        """For each word, its document."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words within one document."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        h = rolling(self.hash, n)
        room = np.repeat(self.bounds[1:], self.counts())[: len(h)]
        at = np.flatnonzero(np.arange(n, len(h) + n) <= room)
        return at, h[at]


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n items of x, whatever documents they cross."""
    power, inverse = _powers(WORD_BASE, len(x) + 1)
    total = np.empty(len(x) + 1, U64)
    total[0] = 0
    np.cumsum(x * power[: len(x)], out=total[1:])
    m = len(x) - n + 1
    return mix((total[n:] - total[:m]) * inverse[:m] + U64(n * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each document's distinct n-word shingles in ascending order; of fewer words, all as one."""
    at, h = words.windows(n)
    counts, docs = words.counts(), len(words.bounds) - 1
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(bounds[-1], U64)
    long = np.repeat(counts >= n, per)
    out[long] = h
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        out[bounds[i]] = rolling(words.hash[words.bounds[i] : words.bounds[i + 1]], int(counts[i]))[0]
    fresh = np.ones(len(out), bool)
    for i in range(docs):
        out[bounds[i] : bounds[i + 1]].sort()
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][per > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[bounds]
