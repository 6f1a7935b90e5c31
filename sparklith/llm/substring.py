"""Exact substring dedup on words by level-wise doubling.

Which windows of n words stand at more than one place? Lengths double from a quarter of n to n. At each length L a
window still in question is stood for by the L-word run with the smallest hash in it. That run is repeated wherever
the window is, at the same offset; so a window whose run stands at one place only is out, and only windows whose runs
are repeated are extended to twice the length. At length n a window stands for itself. Neighbouring windows share
their smallest run, so a level looks at a fraction of all runs and yet loses no repeated window.

Equal texts are one class, known by two 64-bit hashes of the text. After the first level only one row of a class is
carried on, with a weight of two if there are more; so copies, however many, are looked at once. Of it the word hashes of
regions with surviving windows are kept, in one row, so that the places of its repeated runs meet them once. Runs are counted with partial aggregation and joined back by hash, so that a
passage that stands in very many documents is no single task's work. What is read twice is written first.

Runs are compared by hashes: 64 bits up to the last level, which can only let a window through to the next one, and
there 128 bits made from the words' 64-bit hashes. Two different words of equal hash would be one word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, ship_code
from .text import U64, Words, blocks, mix, rolling

KEY = ["h", "g"]
#: A text's regions: where each begins in the text, its length, and all their words and flags of live windows.
REGIONS = "h long, g long, w int, firsts array<int>, sizes array<int>, words binary, live binary"
#: Words of regions worked on at a time; those of one text stay together.
ROOM = 1 << 18
_LOW = U64(0xFFFFFFFF)


def lengths(n: int) -> list[int]:
    """The lengths of the levels: doubled from about a quarter of n, the last one n."""
    out = [max(1, -(-n // 4))]
    while out[-1] < n:
        out.append(min(2 * out[-1], n))
    return out


def runs(words: np.ndarray, live: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``length`` words, for each window start in ``live`` the position of its smallest run; leftmost of equals)."""
    h = rolling(words, length)
    x = (h & ~_LOW) | np.arange(len(h), dtype=U64)
    width, have = n - length + 1, 1
    while have < width:  # x[i] becomes the minimum of x[i : i + have]
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return h, (x[live] & _LOW).astype(np.int64)


def _starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Window starts that leave room for n words in their document."""
    counts = np.diff(bounds)
    room = np.maximum(counts - n + 1, 0)
    ends = np.cumsum(room)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1] - (ends - room), room)


def _key_columns(text: F.Column) -> tuple[F.Column, F.Column]:
    """Two hashes of a text."""
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(0x35), text).alias("g")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*_key_columns(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _first_level(keyed: DataFrame, n: int, length: int) -> DataFrame:
    """``run, h, g, at``: the smallest runs of all windows of all texts, from (h, g, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, gs = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            for row, _, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                live = _starts(words.bounds, n)
                if not len(live):
                    continue
                h, at = runs(words.hash, live, n, length)
                at = np.unique(at)
                doc = np.searchsorted(words.bounds, at, "right") - 1
                yield _batch({"run": h[at].view(np.int64), "h": hs[row + doc], "g": gs[row + doc], "at": (at - words.bounds[doc]).astype(np.int32)})

    return keyed.select(*KEY, "text").mapInArrow(run, "run long, h long, g long, at int")


def _repeated(found: DataFrame, by: list[str], weight: F.Column, gather: Callable[[str], F.Column], work: Workspace, name: str) -> DataFrame:
    """``h, g, at``: for each text, the positions, as ``gather`` brings them together, of those of its runs that stand at more than one place in all.

    The repeated runs are written first. Both sides of the join are then plain shuffles, which Spark splits where one
    run has very many rows; an aggregate on one side would keep them in one task.
    """
    many = work.table(found.groupBy(*by).agg(F.sum(weight).alias("c")).where("c > 1").drop("c"), name)
    return found.join(many, by, "left_semi").groupBy(*KEY).agg(gather("at").alias("at"))


def _regions(texts: DataFrame, n: int, length: int) -> DataFrame:
    """:data:`REGIONS` from (h, g, w, text, at): word hashes of the regions that surviving windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)]
            lists = batch.column(4)
            for row, end, data, offsets in blocks(batch.column(3)):
                words = Words(data, offsets)
                known = np.zeros(len(words), bool)
                for i in range(end - row):
                    known[words.bounds[i] + lists[row + i].values.to_numpy(zero_copy_only=False)] = True
                live = _starts(words.bounds, n)
                if len(live):
                    whole = np.zeros(end - row, np.int64), np.arange(end - row)  # each text is one region from its first word on
                    yield from _cut(words.hash, words.bounds, live, known, n, length, [x[row:end] for x in own], *whole)

    return texts.select(*KEY, "w", "text", "at").mapInArrow(run, REGIONS)


def _cut(words, bounds, live, known, n, length, own, firsts, owner) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The regions of windows in ``live`` whose smallest run is ``known``, a row a text.

    ``firsts`` and ``owner``: for each region before, its first word's place in the text, and the text's row in ``own``.
    """
    _, at = runs(words, live, n, length)
    live = live[known[at]]
    if not len(live):
        return
    part = np.searchsorted(bounds, live, "right") - 1
    head = np.flatnonzero(np.concatenate([[True], (live[1:] > live[:-1] + n) | (part[1:] != part[:-1])]))
    start, stop, part = live[head], live[np.concatenate([head[1:], [len(live)]]) - 1] + n, part[head]
    flag = np.zeros(len(words), bool)
    flag[live] = True
    sizes, row = stop - start, owner[part]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    within = np.arange(ends[-1]) + np.repeat(start - ends[:-1], sizes)
    words, flag = words[within], flag[within]
    text = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    edges = np.concatenate([text, [len(row)]]).astype(np.int32)
    spans = list(zip(ends[edges[:-1]], ends[edges[1:]]))
    lists = {"firsts": firsts[part] + start - bounds[part], "sizes": sizes}
    yield _batch(
        {
            **{name: x[row[text]] for name, x in zip((*KEY, "w"), own)},
            **{name: pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for name, x in lists.items()},
            "words": pa.array([words[a:b].tobytes() for a, b in spans], pa.binary()),
            "live": pa.array([np.packbits(flag[a:b]).tobytes() for a, b in spans], pa.binary()),
        }
    )


class _Opened:
    """A batch of :data:`REGIONS`: word hashes, ``bounds`` of regions in them, live window starts, ``firsts`` and ``owner`` of regions."""

    def __init__(self, batch: pa.RecordBatch):
        words = [np.frombuffer(x, U64) for x in batch.column("words").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(w)) for x, w in zip(batch.column("live").to_pylist(), words)]
        self.words, self.live = np.concatenate(words), np.flatnonzero(np.concatenate(flags))
        self.bounds = np.concatenate([[0], np.cumsum(_items(batch.column("sizes")))]).astype(np.int64)
        self.firsts, self.owner = _items(batch.column("firsts")), _rows(batch.column("firsts"))


def _items(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(lists: pa.ListArray) -> np.ndarray:
    """For each item, its list's row."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _pieces(batch: pa.RecordBatch, room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """Runs of rows with ``room`` words at most; a row with more stands alone."""
    ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64) // 8)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + room, "right")))
        yield batch.slice(i, j - i)
        i = j


def _next_level(regions: DataFrame, n: int, length: int) -> DataFrame:
    """``run, run2, h, g, w, at``: the smallest runs of the surviving windows, by the place of their first word in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                o = _Opened(batch)
                h, at = runs(o.words, o.live, n, length)
                at = np.unique(at)
                again = rolling(mix(o.words ^ U64(0x5851F42D4C957F2D)), length)
                part = np.searchsorted(o.bounds, at, "right") - 1
                own = {k: batch.column(k).to_numpy(zero_copy_only=False)[o.owner[part]] for k in (*KEY, "w")}
                place = (o.firsts[part] + at - o.bounds[part]).astype(np.int32)
                yield _batch({"run": h[at].view(np.int64), "run2": again[at].view(np.int64), **own, "at": place})

    return regions.mapInArrow(run, "run long, run2 long, h long, g long, w int, at int")


def _shrunk(regions: DataFrame, n: int, length: int) -> DataFrame:
    """The regions that are left, from regions with the places ``at`` of their texts' repeated runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                o = _Opened(batch)
                at, row = _items(batch.column("at")), _rows(batch.column("at"))
                # Regions are in the order of texts and places; a run lies in the last one that begins at or before it.
                part = np.searchsorted((o.owner << 32) + o.firsts, (row << 32) + at, "right") - 1
                known = np.zeros(len(o.words), bool)
                known[o.bounds[part] + at - o.firsts[part]] = True
                own = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*KEY, "w")]
                yield from _cut(o.words, o.bounds, o.live, known, n, length, own, o.firsts, o.owner)

    return regions.mapInArrow(run, REGIONS)


def repeated_windows(spark: SparkSession, docs: DataFrame, n: int, work: Workspace) -> DataFrame:
    """``h, g, starts``: for each text with any, the first words of its windows of n words that stand at another place, too.

    Ends early where no window is left. A text is known by its two hashes.
    """
    ship_code(spark)
    keyed, steps = _keyed(docs), lengths(n)
    found = work.table(_first_level(keyed, n, steps[0]), "found")
    at = _repeated(found, ["run"], F.lit(1), F.collect_set, work, "runs")  # copies name a position more than once
    if len(steps) > 1:
        copies = keyed.groupBy(*KEY).agg(F.min("id").alias("id"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("w"))
        picked = work.table(at.join(copies, KEY), "picked")
        for name in ("found", "runs"):
            work.drop(name)
        regions = work.table(_regions(keyed.join(picked, [*KEY, "id"]), n, steps[0]), "regions-0")
        work.drop("picked")
    for k, length in enumerate(steps[1:], 1):
        if regions.isEmpty():
            return spark.createDataFrame([], "h long, g long, starts array<int>")
        found = work.table(_next_level(regions, n, length), "found")
        at = _repeated(found, ["run"] if length < n else ["run", "run2"], F.col("w"), F.collect_list, work, "runs")
        if length < n:
            regions = work.table(_shrunk(regions.join(at, KEY), n, length), f"regions-{k}")
            for name in ("found", "runs", f"regions-{k - 1}"):
                work.drop(name)
    starts = work.table(at.withColumnRenamed("at", "starts"), "starts")
    for name in ("found", "runs", f"regions-{len(steps) - 2}"):
        work.drop(name)
    return starts


def remove_repeats(spark: SparkSession, docs: DataFrame, n: int = 50, work: Workspace | None = None) -> DataFrame:
    """``docs`` with four more columns: ``_kept`` (the kept words joined by one space), ``_n_words``, ``_n_removed``, ``_spans``.

    What is removed is told at :func:`cut_rows`; ``_spans`` are ranges (start, end) of removed words. A column of
    ``docs`` that has one of these four names gives way to the new one.
    """
    new = {f"_{c}": f"cut.{c}" for c in ("kept", "n_words", "n_removed", "spans")}
    old = [F.col(f"row.`{c}`") for c in docs.columns if c not in new]
    return cut_rows(spark, docs, n, work).select(*old, *(F.col(x).alias(c) for c, x in new.items()))


def cut_rows(spark: SparkSession, docs: DataFrame, n: int = 50, work: Workspace | None = None) -> DataFrame:
    """``row, cut`` for each row of ``docs``: all its columns, and what is left of its text.

    Removes every word that is covered by a window of n words which also starts anywhere else, in the same row or
    another. Words are kept as they are, case and marks included; whole texts count. ``cut`` has ``kept`` (the kept
    words joined by one space), ``n_words``, ``n_removed`` and ``spans``. Null text: no words, ``kept`` empty. Texts of
    fewer than n words stay whole. Repeated rows are each other's copies, so windows in them are repeated. Null ids are
    allowed. An empty table stays empty. Columns of ``docs`` may have any names.
    """
    work = work or Workspace(spark, "substring")
    starts = repeated_windows(spark, docs, n, work)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key_columns(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(starts, KEY, "left")

    @F.pandas_udf("kept string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")
    def cut(text, starts):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for t, s in zip(text, starts):
            words = (t or "").encode("utf-8", "surrogatepass").split()  # bytes: splits at space and \x09-\x0D alone
            if s is None or not len(s):
                rows.append((b" ".join(words).decode("utf-8", "surrogatepass"), len(words), 0, []))
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            at = np.asarray(s, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            covered = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
            rows.append((b" ".join([w for w, c in zip(words, covered.tolist()) if not c]).decode("utf-8", "surrogatepass"), len(words), int(covered.sum()), spans))
        return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed", "spans"])

    return joined.select("row", cut(F.col("row.text").cast("string"), "starts").alias("cut"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 35 words that stand at another place, too."""
    out = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 35)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as t from documents),
x as (select r, t, unnest(range(1, len(t) - 33)) as i from w where len(t) >= 35),
g as (select r, i, array_to_string(t[i:i + 34], ' ') as s from x),
d as (select s from g group by 1 having count(*) > 1),
c as (select distinct g.r, g.i + k as p from g join d on g.s = d.s, (select unnest(range(35)) as k)),
e as (select r, t, unnest(range(1, len(t) + 1)) as p from w),
k as (select e.r, count(*) as n, string_agg(e.t[e.p], ' ' order by e.p) as kept from e left join c on c.r = e.r and c.p = e.p where c.r is null group by 1)
select w.doc_id, cast(len(w.t) as bigint) as n_words, cast(len(w.t) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on k.r = w.r
"""
