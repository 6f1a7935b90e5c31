"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, held in sorted arrays that workers map.

Words are known by their 64-bit hash: two words of equal hash would be one. Tasks count on sorted arrays and send one packed row for each shard, so a very
frequent word or pair is one entry of each task. Shards are ranges of hashes; their number grows with the text, so a
shard stays of one size. Four steps: (1) word counts, a sorted hash array a shard, whose order numbers the words;
(2) pair counts, sharded by a hash of the pair, so that no context has a shard of its own; each shard also sums up
its part of every context's and every word's statistics; (3) these parts are added up for each range of words;
(4) workers map the arrays from the shared folder and look pairs up by binary search.

p(w|u) = max(c(uw) - D, 0) / c(u.) + g(u) p(w),  p(w) = max(N(.w) - D', 0) / N(..) + g' / (V + 1),
with D from the counts of counts 1 to 4. After a context that was never seen, p(w) alone. N(.w): kinds of words before w.

Order 3 has two steps more between (2) and (3): (2a) triples, as (number of the pair before, word), are counted in the
shard of that pair, so each pair's followers lie together: words, counts, and an offset for each pair; (2b) each pair's
kinds of words before it, N(.uw), and its back-off weight. Then N(.uw) stands for c(uw) in all of the above, but for
pairs at a text's begin, which nothing precedes: they keep c(uw).

p(w|tu) = max(c(tuw) - D", 0) / c(tu) + g"(tu) p(w|u);  a text's first word has p(w|u) alone, as has any after an unseen pair.

Counts are whole numbers of 64 bits, in a byte each where they are small. Maps hold no file handle, and no more than
``storage.MAPS`` of them are open at a time. Numbers of words and pairs have to fit a 64-bit key together; :func:`learn` says
so where a corpus is too large for that.
"""

from __future__ import annotations

import mmap
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .storage import Files, Workspace, released_shuffles, write_array
from .text import U64, Words, blocks, mix

END = U64(0x6A09E667F3BCC909)
#: Tokens of one shard; distinct entries that a counting task holds before it sends them.
SHARD_TOKENS, HELD = 1 << 23, 1 << 21
#: Triples of a shard that are looked up at a time.
SLICE = 1 << 18
BIG = np.uint32(0xFFFFFFFF)


def squeeze(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending 64-bit keys as 32-bit differences, and those that are too large for it."""
    d = np.diff(keys, prepend=U64(0))
    large = d >= U64(0xFFFFFFFF)
    return np.where(large, BIG, d.astype(np.uint32)).astype("<u4").tobytes(), d[large].tobytes()


def unsqueeze(d: bytes, large: bytes) -> np.ndarray:
    small = np.frombuffer(d, "<u4")
    out = small.astype(U64)
    out[small == BIG] = np.frombuffer(large, U64)
    return np.cumsum(out, dtype=U64)


def shrink(x: np.ndarray, dtype: str) -> tuple[bytes, bytes]:
    """Numbers in a smaller type, and those that are too large for it."""
    most = np.iinfo(dtype).max
    large = x >= most
    return np.where(large, most, x).astype(dtype).tobytes(), x[large].astype("<i8").tobytes()


def unshrink(d: bytes, large: bytes, dtype: str) -> np.ndarray:
    out = np.frombuffer(d, dtype).astype(np.int64)
    out[out == np.iinfo(dtype).max] = np.frombuffer(large, "<i8")
    return out


def pack(x: np.ndarray) -> bytes:
    """Counts in a byte each, then those that are too large for it in eight."""
    return b"".join(shrink(x, "u1"))


def unpack(b: bytes, n: int) -> np.ndarray:
    return unshrink(b[:n], b[n:], "u1")


def add_up(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(distinct keys in ascending order, each value summed over equal keys)."""
    k = np.concatenate(keys) if keys else np.zeros(0, U64)
    order = np.argsort(k, kind="stable")
    k = k[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[head], *(np.add.reduceat(np.concatenate(v)[order], head) if len(k) else np.zeros(0, np.int64) for v in values)


class _Tally:
    """Counts of keys. Keys are held as they come and counted by one sort when there are many."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.held = 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def _fold(self) -> None:
        k, c = np.unique(np.concatenate(self.raw), return_counts=True) if self.raw else (np.zeros(0, U64), np.zeros(0, np.int64))
        self.keys, self.counts = add_up([self.keys, k], [self.counts, c]) if len(self.keys) else (k, c)
        self.raw, self.held = [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Count keys; true if there are so many distinct ones that they should be sent."""
        self.raw.append(keys)
        self.held += len(keys)
        if self.held > HELD:
            self._fold()
        return len(self.keys) > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        k, c = self.keys, self.counts
        self.__init__()
        return k, c


def _tokens(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, token hashes, bounds): each row's words, then the end."""
    for row, end, data, offsets in blocks(batch.column(column)):
        words = Words(data, offsets, lower=True)
        n = end - row
        bounds = words.bounds + np.arange(n + 1)
        out = np.full(len(words) + n, END, U64)
        at = np.ones(len(out), bool)
        at[bounds[1:] - 1] = False
        out[at] = words.hash
        yield row, end, out, bounds


def count_parts(x: np.ndarray) -> list[np.ndarray]:
    """What a file of counts holds: how many do not fit a byte, where they are, what they are, and all as bytes."""
    large = np.flatnonzero(x >= 255)
    return [np.array([len(large)], "<i8"), large.astype("<i8"), x[large].astype("<i8"), np.minimum(x, 255).astype("u1")]


class Counts:
    """Counts by position, read where they lie."""

    def __init__(self, raw: bytes | mmap.mmap):
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.at, self.large = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        self.small = np.frombuffer(raw, "u1", offset=8 + 16 * n)

    def __getitem__(self, at: np.ndarray | slice) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.large[np.searchsorted(self.at, np.arange(len(self.small))[at][big] if isinstance(at, slice) else at[big])]
        return out


class CountFiles(Files):
    def counts(self, name: str, shard: int) -> Counts:
        return Counts(self.raw(f"{name}-{shard:06d}"))


@dataclass
class Model:
    """Where the arrays are and what holds for all of them. ``sizes``, ``pair_sizes``: distinct words, pairs of each shard."""

    folder: str
    bits: int
    sizes: np.ndarray
    pair_sizes: np.ndarray
    total: int = 0
    pair_d: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_d: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_n: np.ndarray = field(default_factory=lambda: np.zeros(4))  # words with N(.w) = 1, 2, more; sum of N(.w)
    order: int = 2
    triple_d: np.ndarray = field(default_factory=lambda: np.zeros(4))

    @property
    def types(self) -> int:
        return int(self.sizes.sum())

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    @property
    def first_pair(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.pair_sizes)])


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the number of entries with counts 1 to 4 (Chen and Goodman 1998)."""
    n = np.maximum(np.asarray(n, float), 0)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = np.zeros(4)
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
        out[k] = min(max(d, 0.05), k - 0.05)  # where data are few the formula leaves its range
    return out


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _splits(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of an ascending array of shards."""
    if len(shard):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(shard[a]), a, b


class Vocabulary:
    """Word numbers from the mapped arrays of hashes."""

    def __init__(self, model: Model, files: Files):
        self.model, self.files, self.first = model, files, model.first

    def find(self, kinds: np.ndarray) -> np.ndarray:
        """The number of each hash, in ascending order; -1 if it is not known."""
        out = np.full(len(kinds), -1, np.int64)
        for s, a, b in _splits(_shard(kinds, self.model.bits)):
            keys, own = self.files.array("words", s, "<u8"), kinds[a:b]
            at = np.searchsorted(keys, own)
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == own[hit]]
            out[a + hit] = self.first[s] + at[hit]
        return out

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; -1 if it is not known."""
        kinds, back = np.unique(hashes, return_inverse=True)
        return self.find(kinds)[back]


def _pairs(model: Model, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each token the pair (word before, word) as one number; the first one's context is number V. All must be known."""
    before = np.empty(len(numbers), np.int64)
    before[1:] = numbers[:-1]
    before[bounds[:-1]] = model.types
    return before.astype(U64) * U64(model.types + 1) + numbers.astype(U64)


class Pairs:
    """Pair numbers, in the order of shards and keys, from the mapped arrays."""

    def __init__(self, model: Model, files: Files):
        self.bits, self.files, self.first = model.bits, files, model.first_pair

    def find(self, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, which of the pairs, their places in it) of the pairs that were seen. ``kinds``: distinct, ascending."""
        shard = _shard(mix(kinds), self.bits)
        order = np.argsort(shard, kind="stable")
        for s, a, b in _splits(shard[order]):
            own, have = kinds[order[a:b]], self.files.array("pairs", s, "<u8")
            at = np.searchsorted(have, own)
            hit = np.flatnonzero(at < len(have))
            hit = hit[have[at[hit]] == own[hit]]
            yield s, order[a + hit], at[hit]

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 if it was not seen."""
        kinds, back = np.unique(keys, return_inverse=True)
        out = np.full(len(kinds), -1, np.int64)
        for s, which, at in self.find(kinds):
            out[which] = self.first[s] + at
        return out[back]


def _ranges(first: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of ascending numbers that are all known."""
    return _splits(np.searchsorted(first, numbers, "right") - 1)


def _within(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Where each wanted value is in x, which ascends between its lo and hi; -1 if it is not there."""
    lo, end = lo.astype(np.int64), hi.astype(np.int64)
    hi = end.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        middle = (lo[open_] + hi[open_]) >> 1
        less = x[middle] < want[open_]
        lo[open_[less]] = middle[less] + 1
        hi[open_[~less]] = middle[~less]
        open_ = open_[lo[open_] < hi[open_]]
    out = np.full(len(lo), -1, np.int64)
    at = np.flatnonzero(lo < end)
    at = at[x[lo[at]] == want[at]]
    out[at] = lo[at]
    return out


def learn(spark: SparkSession, docs: DataFrame, work: Workspace, shard_tokens: int = SHARD_TOKENS, order: int = 2) -> Model:
    """The model of all whole texts of ``docs`` (column text), of order 2 or 3. Null texts are empty: an end alone."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    folder = f"{work.path}/model"
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    about = (text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = max(0, int(np.ceil(np.log2(max(1, about / shard_tokens))))) + (order == 3)  # a shard's triples are about twice its pairs
    model = Model(folder, bits, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), order=order)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def rows() -> Iterator[pa.RecordBatch]:
            k, c = tally.take()
            for s, a, b in _splits(_shard(k, bits)):
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([k[a:b].tobytes()], pa.binary()), pa.array([pack(c[a:b])], pa.binary())], ["shard", "k", "c"])

        for batch in batches:
            for _, _, tokens, _ in _tokens(batch, 0):
                if tally.add(tokens):
                    yield from rows()
        yield from rows()

    def words_of(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in table.column("k").to_pylist()]
        k, c = add_up(parts, [unpack(x, len(p)) for x, p in zip(table.column("c").to_pylist(), parts)])
        s = key[0].as_py()
        write_array(folder, f"words-{s:06d}", k)
        write_array(folder, f"counts-{s:06d}", *count_parts(c))
        return pa.table({"shard": [s], "n": [len(k)], "total": pa.array([int(c.sum())], pa.int64())})

    every = spark.range(1 << bits).select(F.col("id").alias("shard"), F.lit(b"").alias("k"), F.lit(b"").alias("c"))  # each shard has its files, if empty ones
    counted = text.mapInArrow(count_words, "shard long, k binary, c binary").unionAll(every)
    with released_shuffles(spark):
        found = counted.groupBy("shard").applyInArrow(words_of, "shard long, n long, total long").collect()
    for r in found:
        model.sizes[r["shard"]] = r["n"]
        model.total += r["total"]

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, vocabulary = _Tally(), Vocabulary(model, CountFiles(folder))

        def rows() -> Iterator[pa.RecordBatch]:
            k, c = tally.take()
            shard = _shard(mix(k), bits)
            order = np.argsort(shard, kind="stable")  # within a shard the keys still ascend
            k, c, shard = k[order], c[order], shard[order]
            for s, a, b in _splits(shard):
                d, x = squeeze(k[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([d], pa.binary()), pa.array([x], pa.binary()), pa.array([pack(c[a:b])], pa.binary())], ["shard", "d", "x", "c"])

        for batch in batches:
            for _, _, tokens, bounds in _tokens(batch, 0):
                if tally.add(_pairs(model, vocabulary.number(tokens), bounds)):
                    yield from rows()
        yield from rows()

    if model.types + 1 >= 1 << 32:
        raise ValueError(f"{model.types} distinct words: a pair of them does not fit a 64-bit key")
    first, base = model.first, U64(model.types + 1)

    def pairs_of(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unsqueeze(d, x) for d, x in zip(table.column("d").to_pylist(), table.column("x").to_pylist())]
        k, c = add_up(parts, [unpack(x, len(p)) for x, p in zip(table.column("c").to_pylist(), parts)])
        s = key[0].as_py()
        write_array(folder, f"pairs-{s:06d}", k)
        write_array(folder, f"pair_counts-{s:06d}", *count_parts(c))
        return statistics(k, c) if order == 2 else pa.table({"shard": pa.array([s], pa.int64()), "n": pa.array([len(k)], pa.int64())})

    def statistics(k: np.ndarray, c: np.ndarray) -> pa.Table:
        """A shard's part of what contexts and words have, from its pairs and their counts."""
        rows: dict[str, list] = {n: [] for n in ("words", "role", "id", "v0", "v1", "v2", "v3", "n")}

        def add(role: int, ids: np.ndarray, values: list[np.ndarray]) -> None:
            ids = ids.astype(np.int64)
            for w, a, b in _splits(np.minimum(np.searchsorted(first, ids, "right") - 1, len(first) - 2)):
                rows["words"].append(w), rows["role"].append(role), rows["n"].append(None)
                rows["id"].append((ids[a:b] - first[w]).astype("<u4").tobytes())
                for i in range(4):
                    rows[f"v{i}"].append(pack(values[i][a:b]) if i < len(values) else b"")

        if len(k):
            u, w = k // base, k % base
            head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            add(0, u[head], [np.add.reduceat(x, head) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))])
            kinds, many = np.unique(w, return_counts=True)
            add(1, kinds, [many])
        rows["words"].append(-1), rows["role"].append(2), rows["id"].append(b"")
        rows["n"].append([int((c == i).sum()) for i in (1, 2, 3, 4)])
        for i in range(4):
            rows[f"v{i}"].append(b"")
        types = {"words": pa.int64(), "role": pa.int32(), "n": pa.list_(pa.int64())}
        return pa.table({n: pa.array(v, types.get(n, pa.binary())) for n, v in rows.items()})

    every = spark.range(1 << bits).select(F.col("id").alias("shard"), F.lit(b"").alias("d"), F.lit(b"").alias("x"), F.lit(b"").alias("c"))
    paired = text.mapInArrow(count_pairs, "shard long, d binary, x binary, c binary").unionAll(every)
    about_pairs = "words long, role int, id binary, v0 binary, v1 binary, v2 binary, v3 binary, n array<long>"
    if order == 2:
        parts = paired.groupBy("shard").applyInArrow(pairs_of, about_pairs)
    else:
        parts = _learn_triples(spark, text, work, model, paired.groupBy("shard").applyInArrow(pairs_of, "shard long, n long"), statistics, about_pairs)
    parts = work.table(parts, "parts")
    work.drop("before")
    model.pair_d = discounts(np.sum([r["n"] for r in parts.where("role = 2").select("n").collect()], axis=0))  # a row for each shard

    sizes, pair_d = model.sizes, model.pair_d

    def contexts_of(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        n = int(sizes[s]) + (s == len(sizes) - 1)  # the last range also has the context before the first word
        sums, kinds, before = np.zeros(n), np.zeros((3, n)), np.zeros(n, np.int64)
        for r in table.select(["role", "id", "v0", "v1", "v2", "v3"]).to_pylist():
            at = np.frombuffer(r["id"], "<u4")
            if r["role"] == 0:
                sums[at] += unpack(r["v0"], len(at))
                for i in range(3):
                    kinds[i, at] += unpack(r[f"v{i + 1}"], len(at))
            elif r["role"] == 1:
                before[at] += unpack(r["v0"], len(at))
        write_array(folder, f"sums-{s:06d}", sums.astype("<f8"))
        write_array(folder, f"rest-{s:06d}", (np.tensordot(pair_d[1:], kinds, 1) / np.maximum(sums, 1)).astype("<f8"))
        write_array(folder, f"before-{s:06d}", *count_parts(before))
        own = before[: int(sizes[s])]
        found = [int((own == i).sum()) for i in (1, 2, 3, 4)] + [int((own > 2).sum()), int(own.sum())]
        return pa.table({"n": pa.array([found], pa.list_(pa.int64()))})

    every = spark.range(1 << bits).select(F.col("id").alias("words"), F.lit(2).alias("role"), *(F.lit(b"").alias(x) for x in ("id", "v0", "v1", "v2", "v3")), F.lit(None).cast("array<long>").alias("n"))
    found = parts.where("words >= 0").unionAll(every).groupBy("words").applyInArrow(contexts_of, "n array<long>").collect()
    n = np.sum([r["n"] for r in found], axis=0)
    model.word_d = discounts(n[:4])
    model.word_n = np.array([n[0], n[1], n[4], n[5]], float)
    work.drop("parts")
    return model


def _learn_triples(spark: SparkSession, text: DataFrame, work: Workspace, model: Model, paired: DataFrame, statistics: Callable, about_pairs: str) -> DataFrame:
    """Steps (2a) and (2b): the triples' arrays; returns the statistics of the pairs by N(.uw)."""
    folder, bits, base = model.folder, model.bits, U64(model.types + 1)
    # The pairs' arrays have to be there before triples are looked up in them; what comes back is a row for each shard.
    for r in work.table(paired, "before").collect():
        model.pair_sizes[r["shard"]] = r["n"]
    if (int(model.pair_sizes.sum()) + 1) * (model.types + 1) >= 1 << 64:
        raise ValueError(f"{model.types} distinct words after {model.pair_sizes.sum()} pairs: a triple does not fit a 64-bit key")

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = CountFiles(folder)
        tally, vocabulary, pairs = _Tally(), Vocabulary(model, files), Pairs(model, files)

        def rows() -> Iterator[pa.RecordBatch]:
            k, c = tally.take()
            for s, a, b in _ranges(pairs.first, (k // base).astype(np.int64)):
                d, x = squeeze(k[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([d], pa.binary()), pa.array([x], pa.binary()), pa.array([pack(c[a:b])], pa.binary())], ["shard", "d", "x", "c"])

        for batch in batches:
            for _, _, tokens, bounds in _tokens(batch, 0):
                numbers = vocabulary.number(tokens)
                pair = pairs.number(_pairs(model, numbers, bounds))
                inner = np.ones(len(numbers), bool)
                inner[bounds[:-1]] = False
                at = np.flatnonzero(inner)
                if len(at) and tally.add(pair[at - 1].astype(U64) * base + numbers[at].astype(U64)):
                    yield from rows()
        yield from rows()

    def triples_of(key: tuple, table: pa.Table) -> pa.Table:
        # A shard has more triples than pairs: what is not needed any more is let go at once, and the rest goes by slices.
        s, files = key[0].as_py(), CountFiles(folder)
        pairs = Pairs(model, files)
        k = np.concatenate([unsqueeze(d.as_py(), x.as_py()) for d, x in zip(table.column("d"), table.column("x"))])
        c = np.concatenate([unpack(c.as_py(), len(d.as_py()) // 4) for c, d in zip(table.column("c"), table.column("d"))])
        del table
        turn = np.argsort(k, kind="stable")
        k, c = k[turn], c[turn]
        del turn
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        k, c = k[head], np.add.reduceat(c, head) if len(k) else c
        del head
        own, word = ((k // base).astype(np.int64) - pairs.first[s]).astype("<u4"), (k % base).astype("<u4")
        del k
        write_array(folder, f"triple_words-{s:06d}", word)
        write_array(folder, f"triple_counts-{s:06d}", *count_parts(c))
        write_array(folder, f"triple_offsets-{s:06d}", np.concatenate([[0], np.cumsum(np.bincount(own, minlength=int(model.pair_sizes[s])))]).astype("<u4"))
        last, key_of = np.empty(len(own), np.int64), files.array("pairs", s, "<u8")
        for a in range(0, len(own), SLICE):
            last[a : a + SLICE] = pairs.number(key_of[own[a : a + SLICE]] % base * base + word[a : a + SLICE].astype(U64))
        del own, word
        rows: dict[str, list] = {"shard": [-1], "id": [b""], "large": [b""], "v": [b""], "n": [[int((c == i).sum()) for i in (1, 2, 3, 4)]]}
        # A triple is in one shard alone, so the kinds of words before its last two can be added up over shards.
        found, many = np.unique(last, return_counts=True)
        del last
        for t, a, b in _ranges(pairs.first, found):
            small, large = shrink(np.diff(found[a:b], prepend=pairs.first[t]), "<u2")
            rows["shard"].append(t), rows["id"].append(small), rows["large"].append(large), rows["v"].append(pack(many[a:b])), rows["n"].append(None)
        types = {"shard": pa.int64(), "n": pa.list_(pa.int64())}
        out = pa.table({n: pa.array(v, types.get(n, pa.binary())) for n, v in rows.items()})
        pa.default_memory_pool().release_unused()
        return out

    shards = spark.range(1 << bits).select(F.col("id").alias("shard"))
    every = shards.select("shard", *(F.lit(b"").alias(x) for x in ("d", "x", "c")))
    counted = text.mapInArrow(count_triples, "shard long, d binary, x binary, c binary").unionAll(every)
    before = work.table(counted.groupBy("shard").applyInArrow(triples_of, "shard long, id binary, large binary, v binary, n array<long>"), "before")
    model.triple_d = discounts(np.sum([r["n"] for r in before.where("shard < 0").select("n").collect()], axis=0))  # a row for each shard
    triple_d = model.triple_d

    def kinds_of(key: tuple, table: pa.Table) -> pa.Table:
        s, files = key[0].as_py(), CountFiles(folder)
        k, offsets = files.array("pairs", s, "<u8"), files.array("triple_offsets", s, "<u4").astype(np.int64)
        kinds = np.zeros(len(k), np.int64)
        for i, large, v in zip(*(table.column(x) for x in packed)):
            at = np.cumsum(unshrink(i.as_py(), large.as_py(), "<u2"))
            kinds[at] += unpack(v.as_py(), len(at))
        del table
        begin = np.flatnonzero(k // base == base - U64(1))
        kinds[begin] = files.counts("pair_counts", s)[begin]
        write_array(folder, f"pair_kinds-{s:06d}", *count_parts(kinds))
        # How many of a pair's followers came once and how often twice; all others came more often.
        low, some = files.counts("triple_counts", s).small, np.flatnonzero(np.diff(offsets))
        for i in (1, 2):
            n = np.zeros(len(k), np.int64)
            if len(some):
                n[some] = np.add.reduceat(low == i, offsets[some], dtype=np.int64)
            write_array(folder, f"pair_after{i}-{s:06d}", *count_parts(n))
        return statistics(np.asarray(k), kinds)

    packed = ("id", "large", "v")
    every = shards.select("shard", *(F.lit(b"").alias(x) for x in packed))
    return before.where("shard >= 0").select("shard", *packed).unionAll(every).groupBy("shard").applyInArrow(kinds_of, about_pairs)


class Scorer:
    """A worker's view of the model."""

    def __init__(self, model: Model):
        self.model, self.files = model, CountFiles(model.folder)
        self.vocabulary, self.pairs = Vocabulary(model, self.files), Pairs(model, self.files)

    def _by_word(self, numbers: np.ndarray) -> np.ndarray:
        """Four rows: count, N(.w), and as a context the sum and the weight left over. ``numbers``: ascending, none unknown."""
        out, first = np.zeros((4, len(numbers))), self.model.first
        for s, a, b in _splits(np.minimum(np.searchsorted(first, numbers, "right") - 1, len(first) - 2)):
            at = numbers[a:b] - first[s]
            word = at < self.model.sizes[s]  # the context before the first word is none
            out[0, a:b][word] = self.files.counts("counts", s)[at[word]]
            out[1, a:b] = self.files.counts("before", s)[at]
            out[2, a:b] = self.files.array("sums", s, "<f8")[at]
            out[3, a:b] = self.files.array("rest", s, "<f8")[at]
        return out

    def _by_pair(self, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each pair: what stands for its count after one word; its count, weight left over, shard and followers' places."""
        m, get = self.model, self.files.counts
        upper, count, rest = np.zeros((3, len(kinds)))
        shard, lo, hi = np.full(len(kinds), -1), np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        for s, which, at in self.pairs.find(kinds):
            count[which] = upper[which] = get("pair_counts", s)[at]
            if m.order == 3:
                upper[which] = get("pair_kinds", s)[at]
                offsets = self.files.array("triple_offsets", s, "<u4")
                shard[which], lo[which], hi[which] = s, offsets[at], offsets[at + 1]
                once, twice = get("pair_after1", s)[at], get("pair_after2", s)[at]
                more = hi[which] - lo[which] - once - twice
                rest[which] = (m.triple_d[1] * once + m.triple_d[2] * twice + m.triple_d[3] * more) / count[which]
        return upper, count, rest, shard, lo, hi

    def _triple_count(self, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often each word stands among the followers between lo and hi of a shard."""
        order, out = np.argsort(shard, kind="stable"), np.zeros(len(word))
        for s, a, b in _splits(shard[order]):
            own = order[a:b]
            at = _within(self.files.array("triple_words", s, "<u4"), lo[own], hi[own], word[own])
            hit = np.flatnonzero(at >= 0)
            out[own[hit]] = self.files.counts("triple_counts", s)[at[hit]]
        return out

    def score(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each document."""
        m, starts = self.model, bounds[:-1]
        kinds, back = np.unique(tokens, return_inverse=True)
        found = self.vocabulary.find(kinds)
        known, stats = np.flatnonzero(found >= 0), np.zeros((4, len(kinds)))
        stats[:, known] = self._by_word(found[known])
        numbers = found[back]
        count, before, sums, rest = stats[:, back]
        base = np.log10((count + 1) / (m.total + m.types + 1))
        # p(w)
        total = max(m.word_n[3], 1.0)
        d = m.word_d[np.minimum(before, 3).astype(np.int64)]
        over = (m.word_d[1:] @ m.word_n[:3]) / total if m.word_n[3] else 1.0
        lower = np.maximum(before - d, 0) / total + over / (m.types + 1)
        # p(w|u): the context of a token is the token before it
        opening = self._by_word(np.array([m.types]))[:, 0]
        context, sums, rest = (np.concatenate([x[:1], x[:-1]]) for x in (numbers, sums, rest))
        context[starts], sums[starts], rest[starts] = m.types, opening[2], opening[3]
        both = np.flatnonzero((numbers >= 0) & (context >= 0))
        pairs, back = np.unique(context[both].astype(U64) * U64(m.types + 1) + numbers[both].astype(U64), return_inverse=True)
        of_pairs = self._by_pair(pairs)
        pair = np.zeros(len(numbers))
        pair[both] = of_pairs[0][back]
        upper = np.maximum(pair - m.pair_d[np.minimum(pair, 3).astype(np.int64)], 0)
        p = np.where(sums > 0, upper / np.maximum(sums, 1) + rest * lower, lower)
        if m.order == 3:
            # p(w|tu): the pair that ends with the token before
            at = np.full(len(numbers), -1, np.int64)
            at[both] = np.where(of_pairs[1][back] > 0, back, -1)
            earlier = np.concatenate([[-1], at[:-1]])
            earlier[starts] = -1
            seen = np.flatnonzero(earlier >= 0)
            _, count, rest, *places = (x[earlier[seen]] for x in of_pairs)
            triple, own = np.zeros(len(seen)), np.flatnonzero(numbers[seen] >= 0)
            triple[own] = self._triple_count(*(x[own] for x in places), numbers[seen[own]])
            upper = np.maximum(triple - m.triple_d[np.minimum(triple, 3).astype(np.int64)], 0)
            p[seen] = upper / count + rest * p[seen]
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has a token
        return np.diff(bounds), add((numbers >= 0).astype(np.int64)), add(base), add(np.log10(p))


def scores(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for each row of ``docs``; null text: an end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for row, end, tokens, bounds in _tokens(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *map(pa.array, scorer.score(tokens, bounds))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the model of order 3, learned outside the fold of crc32 mod 7 = 2, beside the unigram base."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(spark, docs.where(~held_out("doc_id", 7, 2)), Workspace(spark, "lm"), order=3)
    out = scores(spark, docs, model)
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
