"""Joins, positions and prefix sums."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparklith.operators import joins as J
from sparklith.operators import positional as Q
from sparklith.operators import prefix as W
from sparklith.operators.partitioning import with_bucket
from sparklith.plans.catalog import QUERIES
from sparklith.sources import column


def test_pairs_of_equal_hashes(spark):
    left, right = column(spark, [2, 6, 4, 1, 8, 8, 8, 10], name="h"), column(spark, [2, 4, 6, 8, 3, 8], name="h")
    got = [tuple(r) for r in J.index_pairs(left, right, "h", "h").collect()]
    assert len(got) == 9 == len(set(got))
    assert set(got) == {(0, 0), (1, 2), (2, 1), *itertools.product((4, 5, 6), (3, 5))}


def test_filter_of_pairs(spark):
    left = column(spark, [1, None, 3, 10, 13], name="col1")
    right = Q.gather(column(spark, [1, 2, 3], name="col2"), spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "pos bigint, at bigint"))
    pairs = spark.createDataFrame(list(zip([0, 0, 1, 2, 0], [0, 1, 1, 2, 0])), "left_pos bigint, right_pos bigint")
    assert [tuple(r) for r in J.filter_pairs(pairs, left, right, "col1 = col2").collect()] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("hint", [None, "shuffle_hash", "merge"])
def test_join_is_the_nested_loop(spark, hint):
    rnd = random.Random(3)
    a = [(rnd.choice([None, "x", "y", ""]), rnd.choice([None, 1, 2]), rnd.randrange(9)) for _ in range(60)]
    b = [(rnd.choice([None, "x", "y", "z", ""]), rnd.choice([None, 1, 2]), rnd.randrange(9)) for _ in range(50)]
    left, right = spark.createDataFrame(a, "s string, k bigint, v bigint"), spark.createDataFrame(b, "t string, m bigint, w bigint")
    got = J.hash_join(left, right, [("s", "t"), ("k", "m")], "v >= w", hint)
    want = [(*x, *y) for x in a for y in b if x[0] == y[0] is not None and x[1] == y[1] is not None and x[2] >= y[2]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    l, r = with_bucket(left, ["s", "k"], 3), with_bucket(right, ["t", "m"], 3)
    again = J.bucketed_join(l, r, [("s", "t"), ("k", "m")], 3, "v >= w").select("s", "k", "v", "t", "m", "w")
    assert sorted(map(tuple, again.collect())) == sorted(want)
    assert J.hash_join(left.where("false"), right, [("s", "t")]).count() == 0
    with pytest.raises(ValueError):
        J.hash_join(left, right, [])


@pytest.mark.parametrize("residual", [None, "v >= w"])
def test_spread_join_is_the_nested_loop(spark, monkeypatch, residual):
    """Keys of many rows, of one side's only, of few, and NULL; equal rows multiply, and two blocks of a key meet once."""
    rnd = random.Random(5)
    a = [(rnd.choice([None, "x", "x", "x", "y"]), rnd.choice([None, 1]), rnd.randrange(9)) for _ in range(150)] + [("z", 1, 4), ("only", 1, 4)]
    b = [(rnd.choice([None, "x", "y", "y"]), rnd.choice([None, 1, 2]), rnd.randrange(9)) for _ in range(120)] + [("z", 1, 3), ("z", 1, 3)]
    left, right = spark.createDataFrame(a, "s string, k int, v bigint"), spark.createDataFrame(b, "t string, k bigint, w bigint")
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] is not None and x[1] == y[1] is not None and (not residual or x[2] >= y[2]))
    for few, block in ((1 << 22, 2048), (0, 2048), (0, 8), (0, 1)):
        monkeypatch.setattr(J, "FEW", few), monkeypatch.setattr(J, "BLOCK", block)
        out = J.spread_join(left, right, [("s", "t"), ("k", "k")], residual)
        assert out.columns == ["s", "k", "v", "t", "k", "w"] and sorted(map(tuple, out.collect())) == want
        assert J.spread_join(left.where("false"), right, [("s", "t")]).count() == 0
    with pytest.raises(ValueError):
        J.spread_join(left, right, [])


def test_spread_join_deals_the_pairs_of_one_key(spark, tmp_path):
    """4000 x 1500 rows of one key: no task makes half of the pairs. Also as the query of the catalogue has it."""
    nation = F.lit(7).alias("c_nationkey"), F.lit(7).alias("s_nationkey")
    spark.range(4000).select(F.col("id").alias("c_custkey"), nation[0]).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1500).select(F.col("id").alias("s_suppkey"), nation[1]).write.parquet(str(tmp_path / "supplier.parquet"))
    for name in ("join_null_keys", "join_inner_dup", "join_residual_gt"):
        counts = [r["count"] for r in QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == (4000 * 1500 if name != "join_residual_gt" else sum(min(c, 1500) for c in range(4000)))
        assert max(counts) < sum(counts) / 2


def test_residual_is_a_join_condition(spark):
    left, right = spark.range(100).withColumn("v", F.col("id")), spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("w"))
    plan = J.hash_join(left, right, [("id", "k")], "v > w", "shuffle_hash")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_gather_and_compose(spark):
    data = column(spark, [10, 20, 30])
    index = spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "pos bigint, at bigint")
    assert [r["value"] for r in Q.gather(data, index).orderBy("pos").collect()] == [30, 30, 10]
    twice = Q.re_index(index, spark.createDataFrame([(0, 2), (1, 0)], "pos bigint, at bigint"))
    assert [tuple(r) for r in twice.orderBy("pos").select("pos", "at").collect()] == [(0, 0), (1, 2)]
    assert Q.length(Q.gather(data, index)).first()["n"] == 3
    with pytest.raises(PySparkException, match="out of range"):
        Q.gather(data, spark.createDataFrame([(0, 7)], index.schema)).collect()


def test_zip_checks_lengths(spark):
    a, b = column(spark, [1, 2, 3], name="a"), column(spark, [4, 5, 6], name="b")
    assert [tuple(r) for r in Q.aligned_zip(a, b).orderBy("pos").collect()] == [(0, 1, 4), (1, 2, 5), (2, 3, 6)]
    with pytest.raises(PySparkException, match="differ in length"):
        Q.aligned_zip(a, b.where("pos < 2")).collect()


def test_positions_are_contiguous(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(-5000, 5000), 300)], "k bigint")
    rows = Q.with_position(df, "k").orderBy("k").collect()
    assert [r["pos"] for r in rows] == list(range(300))
    small = W.row_position(df, "k", chunk=64).orderBy("k").collect()
    assert [r["pos"] for r in small] == list(range(300))
    by = W.position_within(df.withColumn("b", F.when(F.col("k") % 3 != 0, F.col("k") % 3)), ["b"], "k", chunk=16)
    counts = by.groupBy("b").agg(F.count("*").alias("n"), F.max("pos_in").alias("m"), F.count_distinct("pos_in").alias("d")).collect()
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in counts)


@pytest.mark.parametrize(("start", "expected"), [(0, [1, 3, 6, 10, 15, 21, 28, 36]), (1, [2, 4, 7, 11, 16, 22, 29, 37])])
def test_prefix_sums(spark, start, expected):
    df = column(spark, range(1, 9))
    for out in (W.prefix_sum(df, "value", "pos", start), W.prefix_sum_parallel(df, "value", "pos", start, chunk=2)):
        assert [r["prefix"] for r in out.orderBy("pos").collect()] == expected


@pytest.mark.parametrize("n", [0, 1, 100])
def test_parallel_prefix_sum_is_the_serial_one(spark, n):
    rnd = random.Random(n)
    df = column(spark, [rnd.randrange(1 << 32) for _ in range(n)])
    a = W.prefix_sum(df, "value", "pos", 1).orderBy("pos").collect()
    assert a == W.prefix_sum_parallel(df, "value", "pos", 1, chunk=8).orderBy("pos").collect()
    with pytest.raises(ValueError):
        W.prefix_sum_parallel(df, "value", "pos", chunk=3)


@pytest.mark.parametrize("chunk", [1, 2, 8])
def test_parallel_prefix_sum_with_nulls(spark, chunk):
    rnd = random.Random(chunk)
    for values in ([None, 2, None, 3], [None] * 5, [1, None, None], [rnd.choice([None, None, 4, -9]) for _ in range(40)]):
        df = column(spark, [x or 0 for x in values], valid=[x is not None for x in values])
        a = W.prefix_sum(df, "value", "pos", 1).orderBy("pos").collect()
        assert a == W.prefix_sum_parallel(df, "value", "pos", 1, chunk=chunk).orderBy("pos").collect()


@pytest.mark.parametrize("chunk", [1, 2, 8])
def test_positions_by_sparse_and_clumped_keys(spark, chunk):
    rnd = random.Random(chunk)
    for keys in (rnd.sample(range(1 << 62), 60), [10**15 + i for i in range(40)] + [-(10**15), 7]):
        df = spark.createDataFrame([(x, x % 3) for x in keys], "k bigint, b bigint")
        assert [r["pos"] for r in W.row_position(df, "k", chunk=chunk).orderBy("k").collect()] == list(range(len(keys)))
        by = W.position_within(df, ["b"], "k", chunk=chunk).orderBy("b", "k").collect()
        assert [r["pos_in"] for r in by] == [i for b in range(3) for i in range(sum(x % 3 == b for x in keys))]


def test_ranges_are_even(spark):
    """Keys spread over 2**60: no range has a multiple of the rows of another one."""
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("k"))
    rows, parts = W._ranges(df, ["k"], 1024)
    counts = [r["count"] for r in rows.groupBy("_chunk").count().collect()]
    assert parts == 20 and len(counts) == 20 and max(counts) < 3 * min(counts)


def test_number_of_ranges_is_bounded(spark):
    """Small ranges of a large table would be a task and a file each: no more than MOST_RANGES, and every row is there."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 1, F.col("id")).alias("v"))
    rows, parts = W._ranges(df, ["id"], 32)
    assert parts == W.MOST_RANGES and rows.select("_chunk").distinct().count() <= W.MOST_RANGES and rows.count() == 40_000
    want, total = {}, None
    for i in range(40_000):
        total = (total or 1) + i if i % 3 == 1 else total
        want[i] = total
    assert {r["id"]: r["prefix"] for r in W.prefix_sum_parallel(df, "v", "id", 1, chunk=32).collect()} == want
    assert W._ranges(df.limit(1000), ["id"], 32)[1] == 32


def test_prefix_sum_of_a_large_table_is_not_one_window(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 256)
    df = spark.range(3000).select("id", F.when(F.col("id") > 400, F.col("id") % 7).alias("v"))
    out = W.prefix_sum(df, "v", "id", 1)
    assert {r["id"]: r["prefix"] for r in out.collect()} == {i: 1 + sum(x % 7 for x in range(401, i + 1)) if i > 400 else None for i in range(3000)}
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_bucketed_join_has_no_other_exchange(spark):
    left, right = spark.range(1000).withColumn("v", F.col("id")), spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("w"))
    plan = J.bucketed_join(left, right, [("id", "k")], 4)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 2 and "REPARTITION_BY_NUM" in initial


def test_even_hash_pairs(spark):
    left, right = column(spark, [2, 3, 4, None, -6], name="h"), column(spark, [4, 3, 2, 2, -6], name="h")
    assert {tuple(r) for r in J.even_hash_pairs(left, right, "h", "h").collect()} == {(0, 2), (0, 3), (2, 0), (4, 4)}
