"""MinHash near-duplicates: fast similarity sketches, banding, and verification on the full shingle sets.

Sketch of t coordinates: in round i < t every shingle is thrown into one of t bins with a value i + v; in round t + j
every shingle goes to bin j. A bin keeps its smallest value, so a bin once filled is never changed by a later round,
rounds end when all bins are full, and the last t rounds fill every bin for certain. Two sets agree in a coordinate
with a probability equal to their similarity, with concentration bounds as for independent minima.

Documents with equal sets are one class. Classes that share a band of coordinates meet in a bucket, where full sets
are compared. A class is compared with those alone that it is not connected with yet, which gives a spanning forest of
the links, not all pairs. Buckets larger than a chunk are dealt into chunks, in two ways. What a chunk cannot see, links
across chunks, is found in a second step: the members of all large buckets that are still in several components meet
anew, by each shingle of their prefixes: in one order of all shingles, rare ones first, two sets of similarity p share a
shingle among the first (1 - p) n + 1 of each. Only if so many of several components share one of these rare shingles
that a chunk can't hold them, those outside the largest component are compared with all of them, each pair in one cell
whatever the number of shingles that it shares. Buckets whose members are in one component already are left out, and
buckets with equal members are one bucket.

A set is known by 128 bits made from its shingles' hashes, a shingle by 64 bits, a word by 64 bits: what is equal in
these counts as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .storage import Workspace, ship_code
from .text import U64, Words, blocks, mix, shingle_sets

T, BANDS = 128, 32
#: A bucket is dealt into chunks of about so many classes and so many shingles.
CHUNK, CHUNK_SHINGLES = 512, 1 << 21
#: Ways in which the first step deals a bucket into chunks: two ways connect what each chunk connects.
WAYS = 2
#: Bands of the first step; the second step takes all others.
FIRST = 4
#: Counters that tell frequent shingles from rare ones. They shape prefixes, not results.
COUNTERS = 1 << 16
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def sketches(x: np.ndarray, bounds: np.ndarray, t: int = T) -> np.ndarray:
    """One row of t coordinates for each set (ascending distinct hashes); all-ones for an empty set. t: a power of two."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(n * t, _FULL, U64)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ U64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = (h & U64(t - 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + bin_, (U64(i) << U64(48)) | (h >> U64(16)))
        full = (out.reshape(n, t) != _FULL).all(1)
        if full.any():
            keep = ~full[doc]
            x, doc = x[keep], doc[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each row and band."""
    n, t = sketch.shape
    part = sketch.reshape(n, bands, t // bands)
    key = np.arange(1, bands + 1, dtype=U64)[None, :] * U64(0xD1342543DE82EF95)
    for j in range(part.shape[2]):
        key = mix(key ^ part[:, :, j]) * U64(0x2545F4914F6CDD1D)
    return key


def nodes(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit fingerprint of each set, as rows of two numbers: sums of two hashes of its members."""
    out = np.zeros((len(bounds) - 1, 2), U64)
    for k, seed in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(x ^ U64(seed)))])
        out[:, k] = mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64))
    return out


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def signatures(docs: DataFrame, n: int, lower: bool = True) -> DataFrame:
    """``doc_id, h, n_shingles, node, keys`` for each row, h a hash of its text; an empty set has a null node and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(2)):
                x, bounds = shingle_sets(Words(data, offsets, lower), n)
                sizes = np.diff(bounds)
                keys = band_keys(sketches(x, bounds)).astype(np.int64)
                mask = sizes == 0
                node = pa.array([None if m else r.tobytes() for m, r in zip(mask, nodes(x, bounds))], pa.binary())
                lists = pa.array([None if m else r for m, r in zip(mask, keys)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(sizes), node, lists], ["doc_id", "h", "n_shingles", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, h long, n_shingles long, node binary, keys array<long>")


def full_sets(docs: DataFrame, n: int, lower: bool = True) -> DataFrame:
    """``node, items``: each row's shingle set as ascending little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                x, bounds = shingle_sets(Words(data, offsets, lower), n)
                items = pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([_bytes(nodes(x, bounds)), items], ["node", "items"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "node binary, items binary")


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set, in one order of all, any set of ``percent`` similarity has to share one of."""
    return sizes - -(-percent * sizes // 100) + 1


def forest(sets: list[np.ndarray], group: np.ndarray, percent: int, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that, with the given groups, connect all that any links connect; a link: similarity of at least percent/100.

    Members of one group are connected already. Every member outside the largest group, or every one that ``asks`` marks,
    is compared with all members that it is not connected with yet. No set is empty. Shingles that a quarter of the
    sets hold are counted by a product of matrices, of at most 16 bytes a shingle of all sets, the others by their holders.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    _, kind, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = count > 1
    common = shared & (4 * count >= m)
    column, few = (np.cumsum(common) - 1)[kind], (shared & ~common)[kind]
    held = common[kind]
    dense = np.zeros((m, int(common.sum())), np.float32)
    dense[owner[held], column[held]] = 1
    rare, holder = kind[few], owner[few]
    ends = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=m))])
    order = np.argsort(rare, kind="stable")
    by_item, holders = rare[order], holder[order]
    lo, hi = np.searchsorted(by_item, rare, "left"), np.searchsorted(by_item, rare, "right")
    label = np.unique(group, return_inverse=True)[1]
    asks = np.flatnonzero(label != np.argmax(np.bincount(label)) if asks is None else asks)
    left = int(label.max()) + 1  # components
    links = []
    for at in range(0, len(asks), 256):
        if left == 1:
            break
        some = asks[at : at + 256]
        for i, both in zip(some.tolist(), dense[some] @ dense.T):
            if left == 1:
                break
            own = slice(ends[i], ends[i + 1])
            both = both.astype(np.int64) + np.bincount(holders[_ranges(lo[own], hi[own])], minlength=m)
            near = np.flatnonzero((label != label[i]) & (100 * both >= percent * (sizes + sizes[i] - both)))
            merged, first = np.unique(label[near], return_index=True)
            if len(merged):
                links += [(i, int(near[k])) for k in first]
                label[np.isin(label, merged)] = label[i]
                left -= len(merged)
    return links


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    span = hi - lo
    ends = np.cumsum(span)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - span), span)


def _slots(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> U64(48)).astype(np.int64) % COUNTERS


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``item, node, root, n`` from (node, root, items): the shingles of each set's prefix, by rareness (``COUNTERS`` counters) and hash."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, _slots(np.frombuffer(x.as_py(), U64)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    often = np.zeros(COUNTERS, np.int64)
    for r in sets.select("items").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # COUNTERS rows at most
        often[r["slot"]] = r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], []
            for items in batch.column(2):
                x = np.frombuffer(items.as_py(), U64)
                found.append(x[np.lexsort((x, often[_slots(x)]))][: int(prefix_sizes(np.array(len(x)), percent))])
                size.append(len(x))
            if found:
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(size, pa.int64()).take(at)], ["item", "node", "root", "n"])

    return sets.select("node", "root", "items").mapInArrow(run, "item long, node binary, root binary, n long")


def _links_within(groups: DataFrame, percent: int) -> DataFrame:
    """``a, b`` from rows (bucket, chunk, node, root, ask, items): the forest of each (bucket, chunk).

    Where ``ask`` is null, those outside the chunk's largest component ask.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = table.column("node").combine_chunks().to_pylist()
        sets = [np.frombuffer(x, U64) for x in table.column("items").to_pylist()]
        root = np.array([x.hex() for x in table.column("root").to_pylist()])
        ask = table.column("ask")
        found = forest(sets, root, percent, None if ask.null_count else ask.to_numpy().astype(bool))
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.binary()), "b": pa.array([node[j] for _, j in found], pa.binary())})

    return groups.groupBy("bucket", "chunk").applyInArrow(run, "a binary, b binary")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, work: Workspace | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (doc_id, text).

    Links rows whose sets of ``words``-word shingles have a similarity of ``percent``/100 or more; a component's id is
    its smallest doc_id and the row that has it is kept. Null or empty text, or text without words: an empty set,
    linked with nothing. Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows are copies of
    each other and bear the same result. A null doc_id takes part; it is kept only where its component has no id at
    all. An empty table gives no rows. Other columns are not read. A pair of similarity s is a candidate with
    probability 1 - (1 - s**4)**32: 0.99999995 at 0.8.
    """
    return _components(spark, docs, words, percent, lower, work).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, work: Workspace | None = None) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: of the smallest doc_id, and of equal rows any one.

    Rows without words are no duplicates and all stay. A null doc_id comes after all others. The decisions are narrow
    rows of doc_id and a hash of the text; texts meet them in one join.
    """
    found = _components(spark, docs, words, percent, lower, work)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("b")
    absent = F.lit(-(1 << 63))
    chosen = found.where("root is not null").groupBy("root").agg(best).select(F.coalesce("b.doc_id", absent).alias("id"), F.col("b.h").alias("h"))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).select(F.coalesce(F.col("doc_id").cast("long"), absent).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = rows.join(chosen, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.first("row").alias("row"))
    return one.select("row.*").unionAll(docs.where(~worded))


def _components(spark: SparkSession, docs: DataFrame, words: int, percent: int, lower: bool, work: Workspace | None) -> DataFrame:
    """``doc_id, h, n_shingles, root, component_id, kept``; no root for an empty set."""
    ship_code(spark)
    work = work or Workspace(spark, "minhash")
    base = work.table(signatures(docs, words, lower), "signatures")
    filled = base.where("node is not null")
    # A class has one row whatever the number of its copies; the smallest id stands for it. Copies have equal keys.
    lead = work.table(filled.groupBy("node").agg(F.min("doc_id").alias("lead"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    absent = F.lit(-(1 << 63))  # a class may have null ids alone
    entries = lead.select("node", "n", F.posexplode("keys").alias("band", "key"))

    size = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"), *_members(), F.min("band").alias("band"))
    # Buckets with the same members are one; that of the lowest band stands for them.
    once = size.where("m > 1").groupBy("m", "x", "y").agg(F.min(F.struct("band", "key", "s")).alias("b"))
    buckets = once.select(F.col("b.key").alias("bucket"), (F.col("b.band") < FIRST).alias("early"), _parts().alias("parts"))
    members = entries.select("node", F.col("key").alias("bucket")).join(buckets, "bucket")
    members = work.table(members, "members")
    if members.isEmpty():
        roots = spark.createDataFrame([], "node binary, root binary")
        return _labelled(base, lead, roots, work)

    wanted = members.select("node").distinct().join(lead, "node").select(F.coalesce("lead", absent).alias("id")).distinct()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), absent).alias("id"), "text")
    chosen = texts.join(wanted, "id", "left_semi")
    sets = work.table(full_sets(chosen, words, lower).dropDuplicates(["node"]), "sets")

    # First step: chunks by themselves. A group of near copies is one component in each chunk; members that two chunks of
    # different ways have in common connect these, so the group is one component after this step, as a rule.
    ways = F.array(*[(F.lit(w) * F.col("parts") + F.pmod(F.xxhash64("node", F.lit(w)), F.col("parts"))).cast("long") for w in range(WAYS)])
    salt = F.explode(F.when(F.col("parts") > 1, ways).otherwise(F.array(F.lit(0).cast("long")))).alias("chunk")
    first = members.where("early").select("bucket", salt, "node").join(sets, "node").withColumns({"root": F.col("node"), "ask": F.lit(None).cast("boolean")})
    links = work.table(_links_within(first, percent), "links-1")
    roots = components(links, work, "roots-1")

    # Second step: what is still in several components, but for early buckets that one chunk has seen whole. What is
    # counted for a bucket is written before it is joined, so that Spark can split the join of a bucket with many members.
    open_ = members.where("not (early and parts = 1)").join(roots.withColumnRenamed("root", "r"), "node", "left")
    open_ = work.table(open_.select("bucket", "parts", "node", F.coalesce("r", "node").alias("root")), "open")
    tally = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("top"))
    tally = work.table(tally.where("roots > 1").select("bucket", F.col("top.root").alias("top")), "tally")
    live = work.table(open_.join(tally, "bucket").select("bucket", "node", "root", "parts"), "live")
    nobody = F.lit(None).cast("boolean").alias("ask")
    dealt, large = live.where("parts = 1").select("bucket", F.lit(0).cast("long").alias("chunk"), "node", "root", nobody), live.where("parts > 1")
    if not large.isEmpty():
        hot = work.table(large.select("node", "root").distinct().join(sets, "node"), "hot")
        held = work.table(prefixes(hot, percent), "held")
        by_root = held.groupBy("item", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), *_members())
        groups = by_root.groupBy("item").agg(F.count(F.lit(1)).alias("roots"), F.sum("k").alias("m"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"), F.max(F.struct("k", "root")).alias("top"))
        groups = groups.where("roots > 1").groupBy("m", "x", "y").agg(F.min(F.struct("item", "s", "top")).alias("b"))
        groups = work.table(groups.select(F.col("b.item").alias("item"), F.col("b.top.root").alias("top"), _parts().alias("parts")), "groups")
        meet = held.join(groups.where("parts = 1"), "item")
        dealt = dealt.unionAll(meet.select(F.col("item").alias("bucket"), F.lit(-1).cast("long").alias("chunk"), "node", "root", nobody))
        # Groups that a chunk can't hold and whose largest component is the same are one family, so that a pair meets
        # there once, however many shingles it shares. Its cells are all pairs of a part of the outsiders and one of the members.
        family = work.table(held.join(groups.where("parts > 1"), "item").select("top", "node", "root", "n").distinct(), "family")
        outside = F.col("root") != F.col("top")
        parts = family.groupBy("top").agg(_cells(F.lit(True)).alias("p"), _cells(outside).alias("q"))
        grid = family.join(work.table(parts, "grid"), "top").withColumns({"i": F.pmod(F.xxhash64("node", F.lit(1)), F.col("q")), "j": F.pmod(F.xxhash64("node"), F.col("p"))})
        as_member = F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda i: i * F.col("p") + F.col("j"))
        as_asking = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda j: F.col("i") * F.col("p") + j)
        grid = grid.withColumn("c", F.explode(F.when(outside, F.array_union(as_member, as_asking)).otherwise(as_member)))
        asks = outside & (F.floor(F.col("c") / F.col("p")) == F.col("i"))
        dealt = dealt.unionAll(grid.select(F.xxhash64("top").alias("bucket"), (-2 - F.col("c")).alias("chunk"), "node", "root", asks.alias("ask")))
    more = work.table(_links_within(dealt.join(sets, "node"), percent), "links-2")
    final = components(links.unionAll(more), work, "roots-2")
    for name in ("members", "sets", "links-1", "links-2", "open", "tally", "live", "hot", "held", "groups", "family", "grid"):
        work.drop(name)
    return _labelled(base, lead, final, work)


def _members() -> tuple[F.Column, F.Column]:
    """Equal for groups of the same nodes."""
    h = F.xxhash64("node")
    return F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(0xFFFFFFFFFF)).alias("y")


def _parts() -> F.Column:
    """Chunks of a group of m sets with b.s shingles in all."""
    return F.greatest(F.ceil(F.col("m") / F.lit(CHUNK)), F.ceil(F.col("b.s") / F.lit(CHUNK_SHINGLES))).cast("int")


def _cells(which: F.Column) -> F.Column:
    """Parts of a family, or of those of it that are asked for, for cells of two parts."""
    m, s = F.count_if(which), F.sum(F.when(which, F.col("n")).otherwise(0))
    return F.greatest(F.ceil(m / F.lit(2 * CHUNK)), F.ceil(s / F.lit(CHUNK_SHINGLES // 2)), F.lit(1)).cast("long")


def _labelled(base: DataFrame, lead: DataFrame, roots: DataFrame, work: Workspace) -> DataFrame:
    """Each row with the smallest doc_id of its component. Each join has a plain table on both sides, so that Spark can split it."""
    linked = work.table(lead.select("node", "lead").join(roots, "node").select("node", "lead", "root"), "linked")
    least = work.table(linked.groupBy("root").agg(F.min("lead").alias("component")), "least")
    label = linked.join(least, "root").select("node", "component", "root")
    of = lead.select("node", "lead").join(label, "node", "left").select("node", F.coalesce("component", "lead").alias("component"), F.coalesce("root", "node").alias("root"))
    of = work.table(of, "labels")
    for name in ("linked", "least", "classes"):
        work.drop(name)
    out = base.join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "h", "n_shingles", "root", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 4-word shingles at a similarity of 0.8."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
s as (select distinct doc_id, unnest(case when len(t) = 0 then [] when len(t) < 4 then [array_to_string(t, ' ')]
  else list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join m on m.a = d.doc_id
"""
