import random

from sparklith.llm import decontaminate as D

from .helpers import DOCS, edits, prose, rng


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS).selectExpr("*", "'c' as item_id", "1 as distance")


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string").selectExpr("*", "2 as doc_id")


def changed(rnd, w, n):
    w = list(w)
    for _ in range(n):
        i, kind = rnd.randrange(len(w)), rnd.randrange(3)
        if kind == 0:
            w[i] = f"q{rnd.randrange(10**6)}"
        elif kind == 1:
            w.insert(i, f"q{rnd.randrange(10**6)}")
        else:
            del w[i]
    return w


def test_myers_is_the_table():
    rnd = random.Random(2)
    for _ in range(200):
        p = [rnd.randrange(4) for _ in range(rnd.randrange(1, 90))]
        t = [rnd.randrange(4) for _ in range(rnd.randrange(0, 60))]
        assert D.myers(p, t) == edits(p, t)


def test_finds_what_a_full_scan_finds(spark):
    rnd = rng(6)
    bench = [prose(rnd, rnd.randrange(1, 60), 3000) for _ in range(25)] + ["w1 w2", "solo"]
    texts = []
    for i in range(80):
        w = prose(rnd, rnd.randrange(0, 200), 3000).split(" ")
        if i % 2:
            b = rnd.choice(bench).split(" ")
            w += changed(rnd, b, rnd.randrange(0, len(b) // 3 + 1)) + prose(rnd, 20, 3000).split(" ")
        texts.append(" ".join(w))
    want = set()
    for d, t in enumerate(texts):
        for i, b in enumerate(bench):
            w = b.split(" ")
            scores = edits(w, D.plain(t).split())
            if scores and min(scores) <= int(0.2 * len(w)):
                want.add((d, i, min(scores)))
    best = {}
    for r in D.matches(spark, frame(spark, texts), items(spark, bench)).collect():
        k = (r["doc_id"], r["item_id"])
        best[k] = min(best.get(k, 10**6), r["distance"])
        own = D.plain(texts[k[0]]).split()[r["start_word"] : r["end_word"]]
        assert edits(bench[k[1]].split(" "), own)[-1] == r["distance"] and r["item_words"] == len(bench[k[1]].split(" "))
    assert {(*k, v) for k, v in best.items()} == want
    clean = D.without_hits(spark, frame(spark, texts), items(spark, bench))
    assert {r["doc_id"] for r in clean.collect()} == set(range(80)) - {d for d, _, _ in want}


def test_passes_give_the_same(spark):
    rnd = rng(8)
    bench = [prose(rnd, 20, 3000) for _ in range(20)]
    texts = [prose(rnd, 30, 3000) + " " + b for b in bench]
    whole, split = (sorted(map(tuple, D.matches(spark, frame(spark, texts), items(spark, bench), block_words=n).collect())) for n in (10**6, 100))
    assert whole == split and len(whole) == 20


def test_marks_case_and_repeats(spark):
    item = "What is the Name of the third King, and of his Queen?"
    texts = ["x " + item.upper().replace(" ", "\n") + " y " + item, "what is the-name (of the) third king and of his queen", None, "", "..."]
    got = D.matches(spark, frame(spark, texts), items(spark, [item, item, None, "", "?!"]))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == [(0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_empty_tables(spark):
    some = frame(spark, ["a b c"])
    assert D.matches(spark, some, items(spark, [])).count() == 0
    assert D.matches(spark, frame(spark, []), items(spark, ["a b c"])).count() == 0
    assert D.without_hits(spark, some, items(spark, [])).count() == 1
    assert D.without_hits(spark, some.limit(0), items(spark, ["a b c"])).columns == some.columns
    rows = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in D.matches(spark, rows.unionAll(rows), spark.createDataFrame([(None, "a b c")], "item_id long, text string")).collect()] == [(None, None, 0)] * 2


def test_query_is_the_full_scan(spark):
    """op10 on whole tables, against the plain table of edits for every document that shares a word with an item often enough."""
    sf = "/root/testdata/sf0.001"
    bench = [(r["item_id"], D.plain(r["text"]).split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = D.plain(d["text"]).split()
        there = set(w)
        for i, b in bench:
            if b and sum(x in there for x in b) >= len(b) - int(0.2 * len(b)) and min(edits(b, w)) <= int(0.2 * len(b)):
                want.add((d["doc_id"], i))
    got = D.op10_decontamination(spark, sf)
    assert got.columns == ["doc_id", "item_id", "distance", "start_word", "end_word", "item_words"]
    assert want and {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_a_piece_of_very_many_items(spark, monkeypatch):
    rnd = rng(9)
    shared = prose(rnd, 12, 3000)
    bench = [shared + " " + prose(rnd, 20, 10**6) for _ in range(3000)]
    texts = [" ".join([prose(rnd, 5, 3000), shared] * 20), "x " + bench[7], prose(rnd, 10, 3000) + " " + bench[8] + " y"]
    monkeypatch.setattr(D, "PLACES", 1000)
    calls = []
    plain_myers = D.myers
    monkeypatch.setattr(D, "myers", lambda *x: calls.append(1) or plain_myers(*x))
    folder = D.index(spark, items(spark, bench), 0.2, 10**6, D.Workspace(spark, "test"))
    import pyarrow as pa

    found = dict(D._Finder(*folder).rows(pa.array(texts)))
    assert sorted(found) == [1, 2] and [len(x) for x in found.values()] == [1, 1]
    assert len(calls) < 50
    got = D.matches(spark, frame(spark, texts), items(spark, bench)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(1, 7, 0), (2, 8, 0)]


def test_a_very_long_text(spark):
    rnd = rng(10)
    bench = [prose(rnd, 30, 3000)]
    texts = [" ".join([prose(rnd, 1000, 3000)] * 300 + bench + [prose(rnd, 1000, 3000)] * 100)]
    got = D.matches(spark, frame(spark, texts), items(spark, bench)).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in got] == [(0, 0, 300_000)]
