import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklith.llm import warc

BIG = "<html>" + "a" * 200
ROWS = [(1, "http://a/", BIG), (2, "http://b/x y\r\n", BIG), (3, None, BIG + "b"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "é", BIG + "b"), (None, "n", BIG), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]


def made(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)


def test_round_trip(spark, tmp_path):
    warc.write(spark, made(spark), f"file://{tmp_path}/w")
    back = warc.read(spark, f"file://{tmp_path}/w")
    size = lambda t: len((t or "").encode())
    want = [(i, size(t), "revisit" if i in (2, 9) else "response", {2: 1, 9: 3}.get(i)) for i, _, t in ROWS]
    assert result(back) == sorted(want, key=repr)
    for r in back.collect():
        text = next(t or "" for i, _, t in ROWS if i == r["page_id"])
        assert r["payload_digest"] == hashlib.sha256(text.encode()).hexdigest() and r["payload_ok"]
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == text.encode()


def test_files_are_deterministic_and_roll(spark, tmp_path):
    rows = [(i, f"http://{i}", hashlib.sha256(str(i).encode()).hexdigest() * (1 + i % 40)) for i in range(400)]
    listed = []
    for k, parts in enumerate((1, 7)):
        manifest = warc.write(spark, made(spark, rows).repartition(parts), f"file://{tmp_path}/{k}", roll=6000, shard_bytes=60_000)
        listed.append(sorted(tuple(r) for r in manifest.collect()))
    assert listed[0] == listed[1] and len(listed[0]) > 20
    assert all(r[2] <= 6000 or r[1] == 1 for r in listed[0])
    assert sum(r[1] for r in listed[0]) == 400
    order = [(r[4], r[5]) for r in listed[0]]
    assert all(a[1] < b[0] for a, b in zip(order, order[1:]))
    names = {p.name for p in (tmp_path / "0").iterdir() if p.suffix == ".gz"}
    assert names == {r[0] for r in listed[0]}
    assert warc.read(spark, f"file://{tmp_path}/0").count() == 400


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    warc.write(spark, made(spark), f"file://{tmp_path}/w")
    (tmp_path / "w" / ".shard-000000-00000.warc.gz.99.tmp").write_bytes(b"half")
    (tmp_path / "w" / "shard-000099-00000.warc.gz").write_bytes(b"half")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == len(ROWS)


def test_empty_and_repeated_rows(spark, tmp_path):
    warc.write(spark, made(spark, []), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
    warc.write(spark, made(spark, [(1, "a", BIG), (1, "a", BIG), (2, "a", BIG), (2, "a", "x")]), f"file://{tmp_path}/r")
    assert result(warc.read(spark, f"file://{tmp_path}/r")) == [(1, 206, "response", None), (1, 206, "response", None), (2, 1, "response", None), (2, 206, "revisit", 1)]


def test_rows_of_one_id_go_by_their_own_payload(spark, tmp_path):
    a, b, c = BIG, BIG + "b", BIG + "c"
    warc.write(spark, made(spark, [(1, "u", a), (3, "u", c), (5, "u", a), (5, "u", b), (5, "u", c), (7, "u", b)]), f"file://{tmp_path}/w")
    got = {(r["page_id"], r["payload_digest"]): (r["refers_to"], r["payload"] and bytes(r["payload"]).decode()) for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(1, digest(a)): (None, a), (3, digest(c)): (None, c), (5, digest(a)): (1, None), (5, digest(b)): (None, b), (5, digest(c)): (3, None), (7, digest(b)): (5, None)}


def test_query_agrees_with_sql(spark):
    got = sorted(map(tuple, warc.op1_warc(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    assert got == sorted(con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.OP1_SQL})").fetchall())


def test_bounds_are_found_in_a_job_a_level(spark, tmp_path):
    """2000 ranges that are each heavier than two shards, far apart."""
    rnd = random.Random(3)
    starts = sorted(rnd.sample(range(-(2**50), 2**50), 2000))
    rows = [(i * 4096 + k, 400) for i in starts for k in range(4)]
    light = spark.createDataFrame(rows, "page_id long, size long")
    context = spark.sparkContext
    context.setJobGroup("bounds", "bounds")
    bounds = warc.shard_bounds(light, 700)
    context._jsc.clearJobGroup()
    assert len(context.statusTracker().getJobIdsForGroup("bounds")) < 100  # 14 levels, each of a few jobs as Spark counts them
    shards = bounds.shard(np.array([r[0] for r in rows]), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64))
    assert (np.diff(shards) >= 0).all() and np.bincount(shards).max() <= 2


def test_one_id_of_very_many_rows_has_several_shards(spark, tmp_path):
    body = lambda i: hashlib.sha256(str(i).encode()).hexdigest() * 4
    rows = [(None, f"n{i}", body(i)) for i in range(200)] + [(7, f"u{i}", body(500 + i)) for i in range(200)] + [(i, "u", body(900 + i)) for i in range(20)] + [(30 + i, "v", body(500 + i)) for i in range(0, 200, 9)]
    manifest = warc.write(spark, made(spark, rows), f"file://{tmp_path}/w", shard_bytes=20_000)
    shards = {r["file"].split("-")[1] for r in manifest.where("first_page <=> last_page and (first_page is null or first_page = 7)").collect()}
    assert len(shards) > 12
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted(((r["page_id"], r["payload_digest"]) for r in got), key=repr) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, _, t in rows), key=repr)
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {30 + i: 7 for i in range(0, 200, 9)}


def test_damaged_archives_raise(spark, tmp_path):
    warc.write(spark, made(spark), f"file://{tmp_path}/w")
    path = next(p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz")
    whole = path.read_bytes()
    half = whole[: whole.index(b"\x1f\x8b\x08", 10)]  # the first record alone
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 255
    for bad in (half, bytes(broken), whole + half):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="is not the file|digest|ends within|Error -3|incorrect"):
            warc.read(spark, f"file://{tmp_path}/w").collect()
    path.unlink()
    with pytest.raises(Exception, match="No such file"):
        warc.read(spark, f"file://{tmp_path}/w").collect()


def test_a_very_long_payload(spark, tmp_path):
    rows = [(1, "u", "0123456789" * 3_000_000), (2, "u", "0123456789" * 3_000_000), (3, "u", "x")]
    warc.write(spark, made(spark, rows), f"file://{tmp_path}/w")
    assert result(warc.read(spark, f"file://{tmp_path}/w")) == [(1, 30_000_000, "response", None), (2, 30_000_000, "revisit", 1), (3, 1, "response", None)]
