"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Each task tokenises its own rows and packs them block by block, so nothing is shuffled and a lost task is simply
run again with the same result. Within a block the pieces are placed longest first, each into the tightest open
window that still holds it, found in a segment tree indexed by remaining capacity. Windows that are still mostly
empty at a block's end are taken up again by the next block of the same task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LatinBPE
from .storage import ship_code
from .text import Words, blocks

WINDOW = 4096
END_ID = 2
#: Tokens that one round of best fit sees; bounds a task's memory at any input size.
BLOCK_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..window: how many open windows have each; tightest fit by descent."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the smallest capacity of at least ``least``."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        window_id = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, window_id


def best_fit_decreasing(lengths: list[int], window: int, open_windows: list[int] = ()) -> tuple[list[int], list[int], list[int]]:
    """Place pieces of at most ``window`` tokens. ``open_windows``: what is free in windows 0, 1, ... that are there already.

    Returns each piece's window and offset, and what is free in each window afterwards. Ties go to the earlier piece.
    """
    tree, free = CapacityTree(window), list(open_windows)
    for i, capacity in enumerate(free):
        if capacity:
            tree.add(capacity, i)
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if found := tree.take(n):
            capacity, w = found
        else:
            capacity, w = window, len(free)
            free.append(window)
        where[i], offset[i] = w, window - capacity
        free[w] = capacity - n
        if capacity > n:
            tree.add(capacity - n, w)
    return where, offset, free


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins words over white space: each distinct word is encoded once.

    Punctuation that closes a word after a letter is split off first, as the tokenizer would do. Plain Latin words go
    through :class:`LatinBPE`, all others through the tokenizer.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bpe, self.most = Tokenizer.from_file(path), LatinBPE(path), most
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        folded = b"\n".join(words).decode().lower().encode()
        data = np.frombuffer(folded + b"\n", np.uint8)
        end = np.flatnonzero(data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        plain = self.bpe.plain(data, start, end)
        ids, sizes = self.bpe.encode(data, start[plain], end[plain])
        all_sizes = np.zeros(len(words), np.int64)
        all_sizes[plain] = sizes
        other = np.flatnonzero(~plain)
        rest: list[int] = []
        if len(other):
            for i, x in zip(other, self.tokenizer.encode_batch([words[i].decode() for i in other], add_special_tokens=False)):
                all_sizes[i] = len(x.ids)
                rest += x.ids
        base = len(self.ids)
        first = np.zeros(len(words), np.int64)
        first[plain] = base + np.cumsum(sizes) - sizes
        first[other] = base + len(ids) + np.cumsum(all_sizes[other]) - all_sizes[other]
        self.ids = np.concatenate([self.ids, ids, np.array(rest, np.uint32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.sizes = np.concatenate([self.sizes, all_sizes])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a block's documents."""
        words = Words(data, offsets)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        words.split_tails()
        fresh, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        slot = np.searchsorted(self.known, fresh)
        new = np.ones(len(fresh), bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != fresh[inside]
        if new.any():
            raw = data.tobytes()
            starts, ends = words.start[at[new]].tolist(), words.end[at[new]].tolist()
            self._learn(fresh[new], [raw[a:b] for a, b in zip(starts, ends)])
            slot = np.searchsorted(self.known, fresh)
        slot = slot[back]
        sizes = self.sizes[slot]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[_spans(self.first[slot], sizes)]
        return ids, ends[words.bounds]


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i]+sizes[i]-1, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


class _Packer:
    """Pieces gathered so far, and windows carried over from the block before."""

    def __init__(self, base: int, window: int):
        self.base, self.window, self.next = base, window, 0
        self.rows: list[tuple] = []
        self.carried: list[tuple[int, int]] = []  # (sequence, free)

    def flush(self) -> Iterator[pa.RecordBatch]:
        lengths = [len(r[2]) for r in self.rows]
        where, offset, free = best_fit_decreasing(lengths, self.window, [f for _, f in self.carried])
        names = [s for s, _ in self.carried]
        names += range(self.next, self.next + len(free) - len(names))
        self.next += len(free) - len(self.carried)
        self.carried = [(s, f) for s, f in zip(names, free) if 4 * f >= self.window]
        for i in range(0, len(self.rows), 4096):
            part = self.rows[i : i + 4096]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([r[1] for r in part], pa.int64()),
                    pa.array(lengths[i : i + 4096], pa.int64()),
                    pa.array([r[2].astype("<u4").tobytes() for r in part], pa.binary()),
                    pa.array([r[3] for r in part], pa.int64()),
                    pa.array([self.base + names[w] for w in where[i : i + 4096]], pa.int64()),
                    pa.array(offset[i : i + 4096], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
        self.rows = []


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their token ids (little-endian unsigned 32-bit) and places.

    One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``. A document is its text's ids,
    then ``end_id``; it is cut into whole windows and a rest. Null or empty text: the end id alone. Repeated rows are
    packed each for itself; a null doc_id stays null; an empty table gives no rows; other columns are not read.
    ``sequence_id`` is the task's number times 2**33 plus a running number, so it is unique but not dense.
    """
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer, held = WordTokenizer(tokenizer), _Packer(TaskContext.get().partitionId() << 33, window), 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for row, end, data, offsets in blocks(batch.column(1)):
                ids, bounds = coder.encode(data, offsets)
                for i in range(end - row):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                    for start in range(0, len(own), window):
                        packer.rows.append((ids_of[row + i], start, own[start : start + window], len(own)))
                    held += len(own)
                    if held >= block_tokens:
                        yield from packer.flush()
                        held = 0
        yield from packer.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 ids of ``word_bpe_49k.json``, one row per piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
