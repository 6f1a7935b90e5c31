"""Benchmark decontamination by pigeonhole edit matching on words.

A test item of m words may be hit with up to k word edits (insertions, deletions, substitutions). Cut into k + 1
pieces, at least one piece of any such hit is untouched; so every place where a piece stands exactly is found through
hashes of word runs. Of these places, those whose surroundings lack more of the item's words than there are edits are
left out, all at once; at the others the item is verified with Myers' bit-parallel distance.

Items are indexed by executors, in blocks, into files that the tasks map; equal items are one there. A document's words
are looked at once for all blocks, and documents are never shuffled. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Files, Workspace, ship_code, write_array
from .text import U64, Words, blocks, mix, rolling

#: Edits allowed, as a share of an item's words.
BUDGET = 0.2
#: Words of the test items of one block, about.
BLOCK_WORDS = 4_000_000
#: Places that are looked at together.
PLACES = 1 << 14
_MARKS = {i: " " for i in [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]}

_SPACED = bytes(0x20 if i in _MARKS else i for i in range(256))


def plain(text: str | None) -> str:
    """Lower case, ASCII punctuation as space: what words are taken from."""
    return (text or "").lower().translate(_MARKS)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of the plain words) of each text."""
    for row, end, data, offsets in blocks(pa.array([plain(t) for t in texts], pa.large_string())):
        words = Words(data, offsets)
        for i in range(end - row):
            yield row + i, words.hash[words.bounds[i] : words.bounds[i + 1]]


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """For each end in ``text``, the least edits that turn the pattern into a substring ending there (Myers 1999, Hyyro 2003)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    plus, minus, score, out = full, 0, m, []
    for x in text:
        eq = masks.get(x, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = minus | ~(d0 | plus) & full
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        plus = hn | ~(d0 | hp) & full
        minus = hp & d0
        out.append(score)
    return out


def build(folder: str, block: int, texts: list[str], keys: np.ndarray, share: float) -> list[int]:
    """Write the index of one block of items: words, budgets, and pieces by length and hash. Returns the pieces' lengths."""
    words, own, budget, pieces = [], [], [], []
    for i, h in word_hashes(texts):
        m = len(h)
        if not m:
            continue  # an item without words is hit by nothing
        k = int(share * m)
        cuts = [round(j * m / (k + 1)) for j in range(k + 2)]
        pieces += [(b - a, rolling(h[a:b], b - a)[0], len(own), a) for a, b in zip(cuts[:-1], cuts[1:])]
        own.append(i), words.append(h), budget.append(k)
    pieces.sort()
    length, hashes, item, at = (np.array([p[j] for p in pieces], U64 if j == 1 else np.int64) for j in range(4))
    seen = np.zeros(1 << 22, bool)  # a first look: the upper bits of the pieces' hashes
    seen[(hashes >> U64(42)).astype(np.int64)] = True
    bounds = np.concatenate([[0], np.cumsum([len(h) for h in words])]).astype(np.int64)
    arrays = {"words": np.concatenate(words) if words else np.zeros(0, U64), "bounds": bounds, "budget": np.array(budget, np.int64), "keys": keys[own], "length": length, "hash": hashes, "item": item, "at": at, "seen": seen}
    for name, x in arrays.items():
        write_array(folder, f"{name}-{block:06d}", x)
    return np.unique(length).tolist()


def index(spark: SparkSession, benchmark: DataFrame, budget: float, block_words: int, work: Workspace) -> tuple[str, int, list[int]]:
    """(folder, blocks, lengths of pieces) of the index of all items. Equal texts are one item, known by two hashes of the text."""
    ship_code(spark)
    folder = f"{work.path}/items"
    once = work.table(benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct().select(*_key(F.col("text")), "text"), "texts")
    total = once.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    parts = max(1, -(-int(total) // block_words))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(table.column("text").is_valid())
        keys = np.stack([table.column(k).to_numpy() for k in ("h", "g")], axis=1)
        found = build(folder, key[0].as_py(), table.column("text").to_pylist(), keys, budget)
        return pa.table({"lengths": pa.array([found], pa.list_(pa.int64()))})

    none = spark.range(parts).select(F.col("id").alias("block"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("string").alias("text"))
    dealt = once.select(F.pmod("h", F.lit(parts)).alias("block"), "h", "g", "text").unionAll(none)
    found = dealt.groupBy("block").applyInArrow(run, "lengths array<long>").collect()  # a row for each block
    return folder, parts, sorted({n for r in found for n in r["lengths"]})


def _key(text: F.Column) -> tuple[F.Column, F.Column]:
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(0x35), text).alias("g")


class _Finder:
    """Where the texts of an Arrow column hold items."""

    def __init__(self, folder: str, parts: int, lengths: list[int]):
        self.files, self.parts, self.lengths = Files(folder), parts, lengths

    def _get(self, name: str, part: int) -> np.ndarray:
        return self.files.array(name, part, {"hash": "<u8", "words": "<u8", "seen": "?"}.get(name, "<i8"))

    def rows(self, column: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
        """(row, its hits) of each row that has any; a hit: the item's two hashes, distance, first word, word after the last, item's words."""
        for r0, _, data, offsets in blocks(column):
            raw = data.tobytes()
            lower = [raw[a:b].decode().lower().encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            folded = np.frombuffer(b"".join(lower).translate(_SPACED), np.uint8)  # what plain() does, on bytes
            words = Words(folded, np.concatenate([[0], np.cumsum([len(x) for x in lower])]))
            found: dict[int, list[tuple]] = {}
            for part, doc, item, starts in self._places(words):
                a, b = words.bounds[doc], words.bounds[doc + 1]
                if hits := self._hits(part, item, words.hash[a:b], [s - int(a) for s in starts]):
                    found.setdefault(doc, []).extend(hits)
            for doc, hits in sorted(found.items()):
                yield r0 + doc, hits

    def _places(self, words: Words) -> Iterator[tuple[int, int, int, list[int]]]:
        """(block, document, item, expected starts) of the places where a piece stands and enough of the item's words are near."""
        doc_of = words.document()
        kept: list[np.ndarray] = []
        for n in self.lengths:
            at, h = words.windows(n)
            upper = (h >> U64(42)).astype(np.int64)
            for part in range(self.parts):
                maybe = np.flatnonzero(self._get("seen", part)[upper])
                if not len(maybe):
                    continue
                a, b = np.searchsorted(self._get("length", part), [n, n + 1])
                hashes = self._get("hash", part)[a:b]
                lo, hi = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                lo, span, at_ = lo[hit] + a, (hi - lo)[hit], at[maybe[hit]]
                ends = np.cumsum(span)
                for p in range(0, int(ends[-1]), PLACES):  # the p-th place: which hit, and which of its items
                    place = np.arange(p, min(p + PLACES, int(ends[-1])))
                    of = np.searchsorted(ends, place, "right")
                    piece = lo[of] + place - (ends[of] - span[of])
                    item, start = self._get("item", part)[piece], at_[of] - self._get("at", part)[piece]
                    doc = doc_of[at_[of]]
                    ok = self._enough(part, words, doc, item, start)
                    kept.append(np.stack([np.full(len(ok), part), doc[ok], item[ok], start[ok]], axis=1))
        if not kept:
            return
        rows = np.unique(np.concatenate(kept), axis=0)
        cut = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1), [True]])) if len(rows) else []
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(rows[a, 0]), int(rows[a, 1]), int(rows[a, 2]), rows[a:b, 3].tolist()

    def _enough(self, part: int, words: Words, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The places where at most as many of the item's words are missing as it may have edits."""
        first, k = self._get("bounds", part), self._get("budget", part)[item]
        m = first[item + 1] - first[item]
        a, b = np.maximum(words.bounds[doc], start - k), np.minimum(words.bounds[doc + 1], start + m + k)
        salt = mix(np.arange(len(item), dtype=U64))  # a word of one place is no word of another one
        near = words.hash[_ranges(a, b)] ^ np.repeat(salt, b - a)
        own = self._get("words", part)[_ranges(first[item], first[item + 1])] ^ np.repeat(salt, m)
        return np.flatnonzero(np.add.reduceat(np.isin(own, near), np.cumsum(m) - m, dtype=np.int64) >= m - k)

    def _hits(self, part: int, item: int, h: np.ndarray, starts: list[int]) -> list[tuple]:
        """The best places of an item near the expected starts in one text."""
        first, k = self._get("bounds", part), int(self._get("budget", part)[item])
        pattern = self._get("words", part)[first[item] : first[item + 1]].tolist()
        own = self._get("keys", part).reshape(-1, 2)[item].tolist()
        m, regions, found = len(pattern), [], []
        for s in starts:
            a, b = max(0, s - k), min(len(h), s + m + k)
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(b, regions[-1][1])
            else:
                regions.append([a, b])
        for a, b in regions:
            text = h[a:b].tolist()
            scores = myers(pattern, text)
            at = 0
            while at < len(scores):  # runs of ends within the budget: the best of each run
                if scores[at] > k:
                    at += 1
                    continue
                to = at
                while to + 1 < len(scores) and scores[to + 1] <= k:
                    to += 1
                best = min(range(at, to + 1), key=lambda i: scores[i])
                # The start: the same distance backwards from the end; the longest such span.
                low = max(0, best + 1 - m - k)
                back = myers(pattern[::-1], text[low : best + 1][::-1])
                length = max(i + 1 for i, x in enumerate(back) if x == min(back))
                found.append((*own, scores[best], a + best + 1 - length, a + best + 1, m))
                at = to + 1
        return found


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    ends = np.cumsum(hi - lo)
    return np.arange(ends[-1]) + np.repeat(lo - (ends - (hi - lo)), hi - lo)


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_words: int = BLOCK_WORDS, work: Workspace | None = None) -> DataFrame:
    """``doc_id, item_id, distance, start_word, end_word, item_words``: each place in a document that is within an item's edit budget.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are not read. Words are lower-case runs without
    ASCII punctuation. Overlapping places of one item count as their best one. Null or empty texts, on either side, hit
    nothing. Items with equal texts and repeated documents give a row each. Null ids stay null. Items are dealt by hash
    into blocks of about ``block_words`` words.
    """
    at = index(spark, benchmark, budget, block_words, work or Workspace(spark, "decontaminate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(*at)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], *hit) for r, hits in finder.rows(batch.column(1)) for hit in hits]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], ["doc_id", "h", "g", "distance", "start_word", "end_word", "item_words"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.mapInArrow(run, "doc_id long, h long, g long, distance long, start_word long, end_word long, item_words long")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), *_key(F.col("text").cast("string"))).where("text is not null")
    return found.join(items, ["h", "g"]).select("doc_id", "item_id", "distance", "start_word", "end_word", "item_words")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in any document that holds a benchmark item within a fifth of its words in edits."""
    return matches(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_words: int = BLOCK_WORDS, work: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept. Each row is judged where it is; none is shuffled."""
    at = index(spark, benchmark, budget, block_words, work or Workspace(spark, "decontaminate"))

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _Finder(*at)
        for text in parts:
            out = np.ones(len(text), bool)
            for row, _ in finder.rows(pa.array(text, pa.string(), from_pandas=True)):
                out[row] = False
            yield pd.Series(out)

    return docs.where(clean(F.col("text").cast("string")))
