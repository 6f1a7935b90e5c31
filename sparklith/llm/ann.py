"""Nearest neighbours by an adaptive dimension scan inside probed lists.

Vectors are dealt into lists by their nearest centroid (k-means on a bounded sample); every vector is indexed, with its
rotation by one random orthogonal matrix in blocks of columns. A query first searches its nearest lists, then, with the
distance of the k-th vector found there, the other lists it probes. Inside a list the column blocks are scanned one after
the other: after each a candidate whose partial distance, scaled up, is above the k-th best by more than a hypothesis test
allows is abandoned, and the k-th best is taken anew from the candidates that are ahead. Survivors are ranked by the exact
double-precision distance of the original vectors. Lists with many vectors are dealt into chunks, lists with many queries
into parts of these; each chunk of candidates meets each part of queries in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace, ship_code
from .text import U64, mix

#: Vectors that centroids and probes are fitted on at most, lists at most, vectors of one chunk, queries of one part.
TRAIN, MOST_LISTS, CHUNK, QUERIES = 32768, 4096, 16384, 1024
#: The recall that the number of probed lists is fitted to, and the vectors of the sample that it is measured with.
GOAL, TRIALS = 0.97, 128
#: Columns of a block, and the test's slack: a candidate at the k-th distance is abandoned with probability below about 1 %.
COLUMNS, SLACK = 16, 2.1
#: Rotated vectors are stored in single precision; this is more than that can be wrong.
ROUNDING = 1e-4


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """``vec_id, v``: vectors of doubles that take part. Null ids, null or zero vectors, and null or non-finite components do not.

    Nor do vectors of another length than ``size``; without it, the most frequent length (the shorter one, if two are).
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    if size is None:
        found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        size = found["d"] if found else 0
    return rows.where(F.size("v") == size)


def kmeans(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids, from distinct starting vectors; deterministic."""
    x = x.astype(np.float32)
    kinds = np.unique(x, axis=0)
    lists = min(lists, len(kinds))
    centres = kinds[np.random.default_rng(5).permutation(len(kinds))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        count = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
    return centres.astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each row the indices of its n nearest centres, nearest first."""
    out = np.empty((len(x), min(n, len(centres))), np.int64)
    norm = (centres * centres).sum(1)
    for i in range(0, len(x), 2048):
        d = norm[None, :] - 2 * (x[i : i + 2048] @ centres.T)
        if out.shape[1] == 1:
            out[i : i + 2048, 0] = d.argmin(1)
        else:
            out[i : i + 2048] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, goal: float = GOAL, trials: int = TRIALS) -> int:
    """How many lists to probe so that, among the vectors of x, a share ``goal`` of true neighbours is in them.

    In a sample neighbours are farther away than in all data, so the number rather errs to the safe side.
    """
    own = nearest(x, centres, 1)[:, 0]
    picked = np.random.default_rng(11).permutation(len(x))[:trials]
    order = nearest(x[picked], centres, len(centres))
    met = np.zeros(len(centres))
    for a, i in enumerate(picked):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        rank = np.empty(len(centres), np.int64)
        rank[order[a]] = np.arange(len(centres))
        np.add.at(met, rank[own[near]], 1)
    return int(np.searchsorted(np.cumsum(met), goal * met.sum())) + 1 if met.sum() else len(centres)


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).normal(size=(d, d)))[0]


def column_blocks(x: np.ndarray, columns: int = COLUMNS) -> list[np.ndarray]:
    """The rotated vectors, in blocks of columns."""
    turned = (x @ rotation(x.shape[1])).astype("<f4")
    return [np.ascontiguousarray(turned[:, a : a + columns]) for a in range(0, x.shape[1], columns)]


def scan(ids: np.ndarray, x: np.ndarray, turned: list[np.ndarray], query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, slack: float = SLACK) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of each query's k nearest among the rows of x with another id.

    ``turned``: the column blocks of x. ``bounds``: a distance for each query beyond which nothing is asked for.
    """
    d, out = x.shape[1], []
    asked = column_blocks(q, turned[0].shape[1])
    for a in range(len(q)):
        alive = np.flatnonzero(ids != query_ids[a])
        best, part, done, ahead = bounds[a] ** 2, np.zeros(len(alive), np.float32), 0, []
        for block, own in zip(turned, asked):
            part = part + ((block[alive] - own[a]) ** 2).sum(1)
            done += block.shape[1]
            if len(alive) > k:  # the k that are ahead: their k-th distance bounds the k-th of all
                ahead.append(alive[np.argpartition(part, k - 1)[:k]])
                best = min(best, ((x[ahead[-1]] - q[a]) ** 2).sum(1).max())
            limit = best * ((1 + slack / np.sqrt(done)) ** 2 if done < d else 1) * (1 + ROUNDING) + 1e-30
            keep = part * (d / done) <= limit
            alive, part = alive[keep], part[keep]
        alive = np.unique(np.concatenate([alive, *ahead]))
        exact = np.sqrt(((x[alive] - q[a]) ** 2).sum(1))
        if len(alive) > k:
            short = exact <= np.partition(exact, k - 1)[k - 1]
            alive, exact = alive[short], exact[short]
        order = np.lexsort((ids[alive], exact))[:k]
        out += [(int(query_ids[a]), int(ids[alive[i]]), float(exact[i])) for i in order]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _block(column: pa.Array) -> np.ndarray:
    """A matrix from a binary column of equally many single-precision numbers a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<f4").reshape(len(column), -1)


def sample(base: DataFrame, drawn: Column, kinds: int) -> np.ndarray:
    """The vectors with the TRAIN smallest hashes ``drawn`` among all rows, of equal rows one; ``kinds``: about how many hashes there are.

    Hashes below a bound are half as many again; only they are ordered. The order goes by hash, so no partition is favoured.
    """
    share = min(1.0, 1.5 * TRAIN / kinds)
    low = base.select(drawn.alias("h"), "v").where(F.pmod("h", F.lit(1 << 40)) <= int(share * (1 << 40)))
    once = low.groupBy("h").agg(F.min("v").alias("v"))
    return np.array([r[0] for r in once.orderBy("h").limit(TRAIN).select("v").collect()])


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, lists: int | None = None, work: Workspace | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest vectors found for each query, nearest first, ties to the smaller id.

    ``vectors`` and ``queries``: vec_id, embedding; other columns are not read. A query never finds its own id. Rows
    that repeat an id are several candidates; of queries that repeat an id one is asked, that with the smallest vector.
    What does not take part is told at :func:`usable`; the length is chosen by ``vectors``, and queries of another one
    don't take part. Fewer than k candidates: all of them. Lists are as many as the square root of the vectors, 4096 at
    most; ``probes`` is fitted on the sample if it is not given. A query whose lists hold too few vectors goes on to
    further lists.
    """
    ship_code(spark)
    work = work or Workspace(spark, "ann")
    base = usable(vectors)
    drawn = F.xxhash64("vec_id", "v", F.lit(3))
    n, kinds, d = base.agg(F.count(F.lit(1)), F.approx_count_distinct(drawn), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = work.table(usable(queries, d).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    train = sample(base, drawn, kinds)
    centres = kmeans(train, lists or max(1, min(MOST_LISTS, round(n**0.5))))
    probes = probes or probes_for(train, centres, k)
    names = [f"b{j}" for j in range(-(-d // COLUMNS))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                near = nearest(x, centres, 1)[:, 0]
                # A running number deals a list into chunks, so that rows that repeat an id don't meet in one.
                row = {"vec_id": batch.column(0), "v": batch.column(1), "list": pa.array(near.astype(np.int32)), "at": pa.array(np.arange(at, at + len(x)))}
                row |= {name: pa.array([r.tobytes() for r in block], pa.binary()) for name, block in zip(names, column_blocks(x))}
                at += len(x)
                yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    blocks = ", ".join(f"{name} binary" for name in names)
    index = work.table(base.mapInArrow(place, f"vec_id long, v array<double>, list int, at long, {blocks}"), "index")
    sizes = np.zeros(len(centres), np.int64)
    for r in index.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK)).astype(np.int64)

    def called(first: bool, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, lists with vectors) that a query goes to first, as many as hold some more than k vectors, or after that."""
        for i, order in enumerate(nearest(x, centres, len(centres)) if len(x) else []):
            enough = int(np.searchsorted(np.cumsum(sizes[order]), 4 * k + 1)) + 1
            order = order[:enough] if first else order[enough : max(probes, enough)]
            yield i, order[sizes[order] > 0]

    def step(asked: DataFrame, first: bool) -> DataFrame:
        """``query_id, vec_id, score`` of the nearest in the lists of this step, from (vec_id, v, bound)."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(centres), np.int64)
            for batch in batches:
                for _, order in called(first, _matrix(batch.column(0))):
                    total[order] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["list", "n"])

        calls = np.zeros(len(centres), np.int64)
        for r in asked.select("v").mapInArrow(count, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # at most MOST_LISTS rows
            calls[r["list"]] = r["n"]
        parts = -(-calls // QUERIES)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dealt, found = mix(batch.column(0).to_numpy().view(U64)), []
                for i, order in called(first, _matrix(batch.column(1))):
                    found += [(i, int(c), p, int(dealt[i] % U64(parts[c]))) for c in order for p in range(chunks[c])]
                if found:
                    at, lists_, chunk, part = (np.array(x) for x in zip(*found))
                    take = pa.array(at)
                    row = [*(batch.column(j).take(take) for j in range(3)), *(pa.array(x.astype(np.int32)) for x in (lists_, chunk, part))]
                    yield pa.RecordBatch.from_arrays(row, ["vec_id", "v", "bound", "list", "chunk", "part"])

        # A row for each list, MOST_LISTS at most; lists that nobody asks are left out.
        shape = spark.createDataFrame([(i, int(chunks[i]), int(parts[i])) for i in np.flatnonzero(parts).tolist()], "list int, chunks int, parts int")
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        rows = index.join(F.broadcast(shape), "list").select("vec_id", "v", F.lit(None).cast("double").alias("bound"), "list", F.pmod("at", "chunks").cast("int").alias("chunk"), part, *names)
        queries = asked.mapInArrow(ask, "vec_id long, v array<double>, bound double, list int, chunk int, part int")
        both = rows.unionAll(queries.select("*", *(F.lit(None).cast("binary").alias(x) for x in names)))

        def find(key: tuple, table: pa.Table) -> pa.Table:
            is_query = table.column("bound").is_valid()
            own, q = table.filter(pc.invert(is_query)), table.filter(is_query)
            found = []
            if own.num_rows and q.num_rows:
                found = scan(own.column("vec_id").to_numpy(), _matrix(own.column("v")), [_block(own.column(x)) for x in names], q.column("vec_id").to_numpy(), _matrix(q.column("v")), q.column("bound").to_numpy(), k)
            return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

        return both.groupBy("list", "chunk", "part").applyInArrow(find, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    near = work.table(best(step(asked.withColumn("bound", F.lit(float("inf"))), True)), "near")
    far = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = work.table(asked.join(far, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounded")
    more = step(bounded, False)
    return best(near.drop("rank").unionAll(more)).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each vector whose id is divisible by 100, by Euclidean distance."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, vectors, vectors.where("vec_id % 100 = 0"), 10)
