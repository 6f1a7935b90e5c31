import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklith.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").selectExpr("*", "'c' as list", "1 as v")


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        found = sorted((float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())), i) for i, y in rows if i != q)[:k]
        out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(found)]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want[q]], rel=1e-12)


def test_exact_if_all_lists_are_probed(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8)) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    queries = rows[:400:20]
    got = ann.search(spark, frame(spark, rows), frame(spark, queries), 10, probes=1000)
    same(result(got), brute(rows, queries, 10))


def test_chunks_give_the_same(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=6)) for i in range(300)] + [(500 + i, np.ones(6)) for i in range(200)]
    monkeypatch.setattr(ann, "CHUNK", 20)
    queries = [rows[0], rows[300], rows[17]]
    got = ann.search(spark, frame(spark, rows), frame(spark, queries), 5, probes=1000, lists=4)
    same(result(got), brute(rows, queries, 5))


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1, 0]), (1, [0, 1]), (2, [0, 0]), (3, None), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [None, 1]), (7, [1, 2, 3]), (None, [1, 1]), (8, [])]
    df = frame(spark, rows)
    got = result(ann.search(spark, df, df, 10))
    assert got == {0: [(1, 1, pytest.approx(2**0.5))], 1: [(1, 0, pytest.approx(2**0.5))]}
    assert ann.search(spark, df.limit(0), df, 10).count() == 0
    assert ann.search(spark, df, df.limit(0), 10).count() == 0
    one = frame(spark, [(0, [1, 0])])
    assert ann.search(spark, one, one, 10).count() == 0


def test_repeated_rows(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [1, 1]), (2, [1, 1])]
    got = result(ann.search(spark, frame(spark, rows), frame(spark, rows), 3))
    assert [x[:2] for x in got[1]] == [(1, 2), (2, 2)] and [x[:2] for x in got[2]] == [(1, 1), (2, 1)]


def test_sample_reaches_the_tail_of_a_sorted_table(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(ann, "TRAIN", 1000)
    middles = rnd.normal(size=(60, 32)) * 4
    rows = [(i, middles[i // 100] + rnd.normal(size=32)) for i in range(6000)]
    queries = rows[5000::20]
    df = frame(spark, rows).orderBy("vec_id").coalesce(4)
    want, got = brute(rows, queries, 10), result(ann.search(spark, df, frame(spark, queries), 10))
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    train = ann.sample(ann.usable(df), F.xxhash64("vec_id", "v", F.lit(3)), 6000)
    kinds = {np.argmin(((middles - x) ** 2).sum(1)) for x in train}
    assert len(train) == 1000 and kinds == set(range(60))


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, np.array(v, float)) for i, v in table if v is not None and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = result(ann.op6_ann(spark, sf))
    assert got.keys() == want.keys() and all([x[0] for x in got[q]] == list(range(1, 11)) for q in got)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        assert all(d == pytest.approx(float(np.sqrt(((exact[q] - exact[i]) ** 2).sum()))) for _, i, d in found)


def test_queries_of_another_length_do_not_take_part(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=8)) for i in range(1, 100) if i % 10] + [(i, rnd.normal(size=4)) for i in range(0, 100, 10)]
    asked = [r for r in rows if r[0] % 10 == 0] + [(1, rows[0][1])]
    got = result(ann.search(spark, frame(spark, rows), frame(spark, asked), 5, probes=1000))
    assert list(got) == [1]
    same(got, brute([r for r in rows if len(r[1]) == 8], [rows[0]], 5))


def test_hot_lists_are_dealt_by_vectors_and_queries(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    middle = rnd.normal(size=20) * 9
    rows = [(i, middle + rnd.normal(size=20)) for i in range(300)] + [(1000, middle)] * 40 + [(2000 + i, rnd.normal(size=20)) for i in range(60)]
    monkeypatch.setattr(ann, "CHUNK", 50)
    monkeypatch.setattr(ann, "QUERIES", 7)
    queries = rows[:300:3] + [rows[300], rows[-1]]
    got = ann.search(spark, frame(spark, rows), frame(spark, queries), 5, probes=1000, lists=4)
    same(result(got), brute(rows, queries, 5))


def test_bounds_and_blocks_leave_the_nearest(spark):
    rnd = np.random.default_rng(8)
    x, q = rnd.normal(size=(3000, 50)), rnd.normal(size=(20, 50))
    ids, qids = np.arange(3000), np.arange(5000, 5020)
    exact = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    tenth = np.sort(exact, axis=1)[:, 9]
    for bounds in (np.full(20, np.inf), tenth):
        got = ann.scan(ids, x, ann.column_blocks(x), qids, q, bounds, 10)
        hits = sum(d <= tenth[i - 5000] for i, _, d in got)
        assert hits >= 0.97 * 200 and all(np.isclose(exact[i - 5000, j], d) for i, j, d in got)
