"""Hashes, buckets, stable partitions, chunks and flattening."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparklith.functions.hashing import bucket_id, row_hash
from sparklith.operators import partitioning as P
from sparklith.sources import attach_validity, column, slice_rows, strings, take, write_table


def buckets(df, bucket="bucket", order="pos_in", value="value", n=4):
    out = {i: [] for i in range(n)}
    for r in df.orderBy(bucket, order).collect():
        out[r[bucket]].append(r[value])
    return out


def with_hash(spark, values, hashes, role="u64", valid=None):
    df = column(spark, values, role, valid=valid)
    return df.join(column(spark, hashes, name="h"), "pos")


def test_hash_properties(spark):
    df = spark.createDataFrame([(0, 1, 5), (1, 1, 4), (2, None, 3), (3, 3, None)], "pos int, a bigint, b bigint")
    h = [r[0] for r in df.orderBy("pos").select(row_hash("a")).collect()]
    assert h[0] == h[1] != h[3] and h[2] is None
    both = [r[0] for r in df.orderBy("pos").select(row_hash("a", "b")).collect()]
    assert both[0] != both[1] and both[2] is None and both[3] is None
    assert both == [r[0] for r in df.orderBy("pos").select(row_hash("a", "b")).collect()]
    with pytest.raises(ValueError):
        row_hash()


def test_bucket_ids(spark):
    df = column(spark, [1, 2, 4, 6, 8, 10, None, -7])
    assert [r[0] for r in df.orderBy("pos").select(bucket_id("value", 2)).collect()] == [1, 2, 0, 2, 0, 2, 3, 1]
    with pytest.raises(ValueError, match="too many buckets"):
        bucket_id("value", 63)


def test_histogram(spark):
    df = P.chunk(column(spark, [1, 2, 4, 6, 8, 10]).withColumn("bucket", bucket_id("value", 2)), 3)
    rows = P.bucket_histogram(df, 4, chunk="chunk", chunks=2).orderBy("chunk", "bucket").collect()
    assert [r["n"] for r in rows] == [1, 1, 1, 0, 1, 0, 2, 0]
    assert [r["offset"] for r in rows] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert [r["n"] for r in P.bucket_totals(df, 4).orderBy("bucket").collect()] == [2, 1, 3, 0]


def test_partition_and_again(spark):
    df = with_hash(spark, [1, 2, 4, 6, 8, 10], [1, 2, 4, 6, 8, 10]).withColumn("bucket", bucket_id("h", 2))
    assert buckets(P.partition_by_bucket(df)) == {0: [4, 8], 1: [1], 2: [2, 6, 10], 3: []}
    first = with_hash(spark, [1, 2, 4, 6, 8, 10], [4, 1, 1, 1, 1, 3]).withColumn("bucket", bucket_id("h", 2)).withColumn("again", F.col("value"))
    first = P.partition_by_bucket(first)
    assert buckets(first) == {0: [1], 1: [2, 4, 6, 8], 2: [], 3: [10]}
    masked = first.withColumn("value", F.when(~((F.col("bucket") == 1) & (F.col("pos_in") == 2)), F.col("value")))
    second = P.repartition_bucket(masked, bucket_id("again", 2))
    assert buckets(second, "bucket2", "pos_in2") == {0: [4, 8], 1: [1], 2: [2, None, 10], 3: []}


def test_partition_of_strings(spark):
    df = with_hash(spark, ["aa", "bb", "cc", "dd", "ee", "fff"], [1, 1, 2, 3, 4, 5], "str", [0, 1, 1, 1, 1, 1]).withColumn("bucket", bucket_id("h", 2))
    assert buckets(P.partition_by_bucket(df)) == {0: ["ee"], 1: [None, "bb", "fff"], 2: ["cc"], 3: ["dd"]}


def test_physical_placement(spark):
    df = P.place(P.with_bucket(column(spark, range(500)), ["value"], 4), 4)
    assert df.rdd.getNumPartitions() == 16
    assert df.where(F.spark_partition_id() != F.col("bucket")).count() == 0


@pytest.mark.parametrize("bits", [4, 10])
def test_round_trip(spark, bits):
    rnd = random.Random(bits)
    values = ["".join(rnd.choices("abcdef", k=i & 7)) for i in range(1000)]
    df = P.partition_by_bucket(P.with_bucket(strings(spark, values), ["value"], bits))
    flat = P.flatten(df).orderBy("flat").collect()
    assert sorted(r["value"] for r in flat) == sorted(values)
    assert [r["flat"] for r in flat] == list(range(1000))
    assert [r["bucket"] for r in flat] == sorted(r["bucket"] for r in flat)


def test_flatten_keeps_nulls(spark):
    df = P.partition_by_bucket(P.with_bucket(column(spark, [1, None, 3, None]), ["value"], 2))
    assert sorted((r["value"] is None, r["value"] or 0) for r in P.flatten(df).collect()) == [(False, 1), (False, 3), (True, 0), (True, 0)]


@pytest.mark.parametrize(("target", "data", "index"), [([0, 0], [1, 2, 6], [0, 1, 1, 2]), ([3, 3], [1, 5, 6], [0, 1, 1, 2])])
def test_flatten_with_index(spark, target, data, index):
    parts = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5), (3, 0, 6)], "bucket bigint, pos_in bigint, value bigint")
    at = spark.createDataFrame([(0, 0, 0), (1, 0, target[0]), (1, 1, target[1]), (3, 0, 0)], "bucket bigint, i bigint, at bigint")
    d, i = P.flatten_indexed(parts, at)
    assert [r["value"] for r in d.orderBy("flat").collect()] == data
    assert [r["flat"] for r in i.orderBy("flat_i").collect()] == index
    with pytest.raises(PySparkException, match="invalid index"):
        P.flatten_indexed(parts, spark.createDataFrame([(1, 0, 9)], at.schema))[1].collect()


def test_chunks(spark):
    df = column(spark, [1, 5, 6, 4, 5, 6, 4, 5, 6, 8])
    expected = {0: [1, 5, 6], 1: [4, 5, 6], 2: [4, 5, 6], 3: [8]}
    assert buckets(P.chunk(df, 3), "chunk", "pos") == expected
    assert buckets(P.chunk_with_sizes(df, [3, 3, 3, 1]), "chunk", "pos") == expected
    assert buckets(P.chunk_with_sizes(df, [0, 9, 0, 1]), "chunk", "pos") == {0: [], 1: [1, 5, 6, 4, 5, 6, 4, 5, 6], 2: [], 3: [8]}
    # Writing to the first row of each chunk is an expression over the chunk and the position.
    head = P.chunk(df.withColumn("value", F.when(F.col("pos") == 0, 4).otherwise(F.col("value"))), 3)
    changed = head.withColumn("value", F.when(F.col("pos") % 3 == 0, F.col("value") - 1).otherwise(F.col("value")))
    assert buckets(changed, "chunk", "pos") == {0: [3, 5, 6], 1: [3, 5, 6], 2: [3, 5, 6], 3: [7]}
    for sizes in ([3, 3], [11, -1], []):
        with pytest.raises(ValueError):
            P.chunk_with_sizes(df, sizes)
    with pytest.raises(ValueError):
        P.chunk(df, 0)


def test_empty_tables(spark):
    df = column(spark, []).withColumn("bucket", bucket_id("value", 2))
    assert P.flatten(P.partition_by_bucket(df)).count() == 0
    assert [r["n"] for r in P.bucket_totals(df, 4).orderBy("bucket").collect()] == [0, 0, 0, 0]
    assert P.chunk(df, 3).count() == 0
    assert P.chunk_with_sizes(df, []).count() == 0


def test_columns_in_memory(spark, tmp_path):
    df = column(spark, [4, 5, 6], "u32", "n", [1, 0, 1])
    assert take(df, "n") == [4, None, 6]
    assert take(slice_rows(df, 1, 3), "n") == [None, 6]
    with pytest.raises(TypeError):
        take(df, "n", "str")
    with pytest.raises(ValueError):
        column(spark, [1, 2], valid=[1])
    flagged = df.withColumn("f", F.lit(0))
    assert take(attach_validity(flagged, "n", "f"), "n") == [None, None, None]
    write_table(df.withColumn("bucket", F.col("pos") % 2), str(tmp_path / "t"), "bucket")
    assert spark.read.parquet(str(tmp_path / "t")).where("bucket = 0").count() == 2


def test_placement_into_fewer_partitions(spark):
    df = P.place(P.with_bucket(column(spark, range(500)), ["value"], 6), 6, partitions=5)
    assert df.rdd.getNumPartitions() == 5
    at = df.select("bucket", F.spark_partition_id().alias("p")).distinct().orderBy("bucket").collect()
    assert len({r["bucket"] for r in at}) == len(at) and [r["p"] for r in at] == sorted(r["p"] for r in at)
