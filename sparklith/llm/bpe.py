"""Byte-level BPE over many distinct words at once, for plain Latin words; all else goes to the tokenizer itself."""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(1 << 30)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Pairs:
    """Exact lookup (left, right) -> rank in two small hash tables."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.keys = keys
        self.first, self.m1, self.s1 = self._table(keys, np.arange(len(keys)), 22, 0x9E3779B97F4A7C15)
        lost = np.flatnonzero(self.first[(keys * self.m1) >> self.s1] != np.arange(len(keys)))
        for seed in range(1, 1000):
            self.second, self.m2, self.s2 = self._table(keys[lost], lost, 20, 0xD1342543DE82EF95 + 2 * seed)
            if (self.second[(keys[lost] * self.m2) >> self.s2] == lost).all():
                break

    @staticmethod
    def _table(keys, values, bits, multiplier):
        m, s = np.uint64(multiplier & 0xFFFFFFFFFFFFFFFF), np.uint64(64 - bits)
        table = np.zeros(1 << bits, np.int32)
        table[(keys * m) >> s] = values
        return table, m, s

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        a = self.first[(keys * self.m1) >> self.s1]
        hit = self.keys[a] == keys
        out = np.where(hit, a, NONE)
        miss = np.flatnonzero(~hit)
        b = self.second[(keys[miss] * self.m2) >> self.s2]
        ok = self.keys[b] == keys[miss]
        out[miss[ok]] = b[ok]
        return out


class LatinBPE:
    """The ids of single-pretoken words (Latin letters only, lower case) of a tokenizer file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = _Pairs(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        ok = np.zeros(256, bool)
        ok[97:123] = ok[0x80:0xC0] = ok[0xC3:0xC9] = True
        self.ok = ok

    def plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words (byte spans of lower-case UTF-8) are letters of U+00C0..U+023F and a-z alone."""
        bad = ~self.ok[data]
        bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        total = np.concatenate([[0], np.cumsum(bad)])
        return (total[end] == total[start]) & (end > start)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of plain words, one after the other."""
        n = len(start)
        sizes = (end - start).astype(np.int64)
        ends = np.cumsum(sizes)
        src = np.arange(ends[-1] if n else 0) + np.repeat(start - (ends - sizes), sizes)
        sym = self.inner[data[src]]
        sym[ends - 1] = self.last[data[end - 1]]
        word = np.repeat(np.arange(n), sizes)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            if len(sym) > 1:
                rank[:-1] = self.pairs.ranks(sym[:-1], sym[1:])
                rank[:-1][word[1:] != word[:-1]] = NONE
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.concatenate([heads, [len(sym)]]))
            best = np.repeat(best, lengths)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, best = sym[keep], word[keep], rank[keep], best[keep]
                if not len(sym):
                    break
            hit = rank == best
            after = np.flatnonzero(hit[1:] & hit[:-1])
            if len(after):  # overlapping pairs such as a a a: every second one, from the left
                index = np.arange(len(hit))
                opens = hit.copy()
                opens[1:] &= ~hit[:-1]
                run = np.maximum.accumulate(np.where(opens, index, 0))
                hit &= (index - run) % 2 == 0
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[1:] = ~hit[:-1]
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=n)
