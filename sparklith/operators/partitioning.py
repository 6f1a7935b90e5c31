"""Hash buckets, stable partitions, chunks, and back to one table.

Which bucket a row is in is a column; :func:`place` also puts the rows there physically. Stability
is a column, too: ``pos_in`` is the row's place inside its bucket in the original order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklith.functions.hashing import bucket_id, row_hash

from .prefix import position_within


def with_bucket(df: DataFrame, keys: list[str], bits: int, name: str = "bucket") -> DataFrame:
    """df with the bucket of its keys' hash; rows with a NULL key are in the last bucket."""
    return df.withColumn(name, bucket_id(row_hash(*keys), bits))


def place(df: DataFrame, bits: int, bucket: str = "bucket", partitions: int | None = None) -> DataFrame:
    """Put each bucket into the partition of its number, or consecutive buckets together into fewer ``partitions``."""
    buckets = 1 << bits
    n = min(partitions or buckets, buckets)
    return df.repartitionById(n, F.floor(F.col(bucket) * F.lit(n) / F.lit(buckets)).cast("int"))


def bucket_histogram(df: DataFrame, buckets: int, bucket: str = "bucket", chunk: str | None = None, chunks: int = 1) -> DataFrame:
    """``chunk, bucket, n, offset``: rows of each bucket in each chunk, with the rows of it in earlier chunks; empty ones count 0.

    Only the counts are large: they come from a partial aggregate, and the grid of chunks and buckets is filled up from
    a range of numbers.
    """
    spark = df.sparkSession
    cell = F.col(chunk).cast("bigint") if chunk else F.lit(0).cast("bigint")
    counts = df.groupBy(cell.alias("chunk"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(chunks * buckets).select(F.floor(F.col("id") / buckets).cast("bigint").alias("chunk"), (F.col("id") % buckets).alias("bucket"))
    full = grid.join(counts, ["chunk", "bucket"], "left").select("chunk", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def bucket_totals(df: DataFrame, buckets: int, bucket: str = "bucket") -> DataFrame:
    """``bucket, n`` for every bucket, the empty ones, too."""
    return bucket_histogram(df, buckets, bucket).select("bucket", "n")


def partition_by_bucket(df: DataFrame, bucket: str = "bucket", pos: str = "pos", name: str = "pos_in") -> DataFrame:
    """A stable partition: each row's place inside its bucket."""
    return position_within(df, [bucket], pos, name)


def repartition_bucket(df: DataFrame, new: Column, old: str = "bucket", pos_in: str = "pos_in", name: str = "bucket2", place_name: str = "pos_in2") -> DataFrame:
    """Partition again: stable in the order of the old bucket and the place in it."""
    return position_within(df.withColumn(name, new), [name], [old, pos_in], place_name)


def chunk(df: DataFrame, size: int, pos: str = "pos", name: str = "chunk") -> DataFrame:
    """df with the number of its chunk of ``size`` rows; the last one may be short."""
    if size < 1:
        raise ValueError("a chunk has a row at least")
    return df.withColumn(name, F.floor(F.col(pos) / F.lit(size)).cast("bigint"))


def chunk_with_sizes(df: DataFrame, sizes: list[int], pos: str = "pos", name: str = "chunk") -> DataFrame:
    """df with the number of its chunk, for chunks of given sizes; an error if they don't add up to the number of rows."""
    n = df.count()
    if sum(sizes) != n or min(sizes, default=0) < 0:
        raise ValueError(f"chunk sizes add up to {sum(sizes)}; there are {n} rows")
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    # The chunk of a position is the number of chunk ends at or before it: a binary search in the ends.
    spark = df.sparkSession
    spans = spark.createDataFrame([(i, e - s, e) for i, (s, e) in enumerate(zip(sizes, ends)) if s], f"{name} bigint, _from bigint, _to bigint")
    # Wide cells make the range join an equality join: each span stands in the cells that it meets.
    cell = max(1, -(-n // max(1, len(sizes))))
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / cell), F.floor((F.col("_to") - 1) / cell))))
    rows = df.withColumn("_cell", F.floor(F.col(pos) / cell))
    hit = rows.join(spans, (rows["_cell"] == spans["_cell"]) & (rows[pos] >= spans["_from"]) & (rows[pos] < spans["_to"]))
    return hit.select(*[rows[c] for c in df.columns], spans[name])


def partition_lengths(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def flatten(df: DataFrame, bucket: str = "bucket", pos_in: str = "pos_in", name: str = "flat") -> DataFrame:
    """One table again, bucket after bucket: each row's position is the rows of earlier buckets plus its place; NULLs stay."""
    counts = partition_lengths(df, bucket)
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    before = counts.select(bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return df.join(before, bucket).withColumn(name, (F.col("_before") + F.col(pos_in)).cast("bigint")).drop("_before")


def flatten_indexed(df: DataFrame, index: DataFrame, bucket: str = "bucket", pos_in: str = "pos_in") -> tuple[DataFrame, DataFrame]:
    """(data, index) of partitions with indexes: only rows that are pointed at are kept, once each, in order.

    ``index``: bucket, i (place in the bucket's index), at (place in the bucket). Returns data with ``flat``, and an
    index ``flat_i, flat``: what the i-th index entry, over all buckets in order, points at.
    """
    used = df.join(index.select(bucket, F.col("at").alias(pos_in)).distinct(), [bucket, pos_in], "left_semi")
    data = flatten(position_within(used, [bucket], pos_in, "_rank"), bucket, "_rank").drop("_rank")
    entries = flatten(index, bucket, "i", "flat_i").withColumnRenamed("at", pos_in)
    found = entries.join(data.select(bucket, pos_in, "flat"), [bucket, pos_in], "left")
    ok = F.when(F.col("flat").isNotNull(), F.col("flat")).otherwise(F.raise_error(F.lit("invalid index")).cast("bigint"))
    return data, found.select("flat_i", ok.alias("flat"))
