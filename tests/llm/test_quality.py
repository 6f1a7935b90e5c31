import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparklith.llm import quality
from sparklith.llm.storage import Workspace
from sparklith.llm.text import blocks

SF = "/root/testdata/sf0.01"


def features(texts):
    return np.concatenate([quality.features(data, offsets) for _, _, data, offsets in blocks(pa.array(texts, pa.string()))])


def test_features_do_not_depend_on_neighbours():
    texts = ["", None, " ", "a", "One two.\nThree?\n\nOne two.", "$$$ @@ ## 12345 | | |", "é" * 50, "WORD " * 400, "x\ny\n" * 20]
    together = features(texts)
    assert np.isfinite(together).all() and together.shape == (len(texts), len(quality.FEATURES))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], features([t])[0]), t
    named = dict(zip(quality.FEATURES, features(["One two.\nThree?\nOne two."])[0]))
    assert np.isclose(named["log_words"], np.log1p(5)) and np.isclose(named["line_repeat"], np.sqrt(1 / 3))
    assert np.isclose(named["upper"], np.sqrt(3 / 24)) and np.isclose(named["capital"], np.sqrt(3 / 5))


def test_scores_are_the_log_densities():
    rnd = np.random.default_rng(2)
    d = 4
    x = [rnd.normal(size=(300, d)) @ rnd.normal(size=(d, d)), rnd.normal(size=(150, d)) + 1]
    model = quality.QDA.fit(np.array([300.0, 150]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    z = (rnd.normal(size=(20, d)) - model.centre) / model.scale
    log = []
    for k in (0, 1):
        cov = model.chol[k] @ model.chol[k].T
        away = z - model.mean[k]
        log.append(np.log([301, 151][k] / 452) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.score(z * model.scale + model.centre), 1 / (1 + np.exp(log[0] - log[1])))


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(1, 9)], "doc_id long, text string")
    for labels in ([], [(i, 1, 0) for i in range(1, 9)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        table, model = quality.trained(spark, docs, marks, Workspace(spark, "quality"))
        scores = [r["score"] for r in quality.scored(table, model).collect()]
        assert len(scores) == 8 and all(0 <= s <= 1 for s in scores)
        assert all(s >= 0.5 for s in scores)


def test_nulls_repeats_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_score": F.lit("c"), "label": F.lit(1), "quality": F.lit(0)})
    more = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.unionAll(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], labels.schema))
    rows = docs.unionAll(more).unionAll(docs.limit(5))
    kept = quality.keep_good(spark, rows, labels)
    assert kept.columns == rows.columns and 0.8 * rows.count() < kept.count() < rows.count()
    assert quality.keep_good(spark, rows.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = quality.op8_quality_qda(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (held.predicted == held.quality).mean() > 0.95
