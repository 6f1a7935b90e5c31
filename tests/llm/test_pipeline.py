import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from sparklith.llm.graph import components
from sparklith.llm.storage import Workspace

from .helpers import DOCS, prose, rng, without_repeats
from .helpers import components as plain_components

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_kept", F.lit(1)).withColumn("item_id", F.lit("x"))
    work, counts = Workspace(spark, "test"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = work.table(stage(spark, docs, SF), name)
        assert docs.columns == before.columns, name
        counts.append(docs.count())
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "near_dedup":
            kept = {d for d, n, _, k in plain_components(rows, 5, 80) if k or not n}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name == "substring_dedup":
            want = {d: (gone, text, kept) for (d, text), (_, gone, kept) in zip(rows, without_repeats([t for _, t in rows], corpus_pipeline.PASSAGE))}
            for r in docs.collect():
                gone, text, kept = want[r["doc_id"]]
                assert r["text"] == (kept if gone else text) and (not gone or r["n_chars"] == len(kept))
            assert any(x[0] for x in want.values())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] < counts[3]
    assert counts[4] > 0.4 * counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == counts[4]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "doc_tokens").collect())) == sorted(map(tuple, pieces.select("doc_id", "start", "length", "doc_tokens").collect()))


def test_edge_rows_pass_through(spark, tmp_path):
    text = prose(rng(1), 80)
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, text, None, None, None), (2, text, None, None, None), (None, text, None, None, 3)]
    for name, own in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(own, DOCS).write.parquet(str(folder / "documents.parquet"))
        for table in ("labels", "benchmark"):
            (folder / f"{table}.parquet").mkdir(parents=True)
            pq.write_table(pq.read_table(f"{SF}/{table}.parquet").slice(0, 0), folder / f"{table}.parquet" / "0.parquet")
        got = corpus_pipeline.run(spark, f"file://{folder}").collect()
        assert sorted((r["doc_id"] or 0, r["length"] > 1) for r in got) == ([(0, False), (1, False), (2, True)] if own else [])


def test_components_of_a_random_graph(spark):
    rnd = rng(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0
