"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass over the texts gives a narrow table of features, which is written to the shared workspace. The class
moments (count, sums, sums of products) are Spark aggregates of it over all labelled rows, so the model's input is a
few hundred numbers whatever the size. A filter need not keep the table: it learns from a bounded sample of the labels
and scores each row where it is. Covariances are shrunk to the pooled one and to a scaled identity; their
Cholesky factors are computed once and scores are differences of Mahalanobis log densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, ship_code
from .text import Words, blocks

FEATURES = ("log_words", "word_len", "letters", "symbols", "digits", "upper", "marked", "distinct", "line_words", "line_repeat", "bars", "capital")
POOL, RIDGE = 0.1, 0.02
#: Labels that a filter learns from at most.
SAMPLE = 1 << 15


def _classes() -> tuple[np.ndarray, ...]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    letter = upper | ((code >= 97) & (code <= 122)) | (code >= 128)
    digit = (code >= 48) & (code <= 57)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    plain = np.isin(code, [44, 46, 39, 45, 59, 58, 63, 33])  # , . ' - ; : ? !
    symbol = ~(letter | digit | space | plain)
    return letter, digit, upper, symbol


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each document of a block; all finite, also for empty texts."""
    letter, digit, upper, symbol = _classes()
    words = Words(data, offsets, lower=True)
    n_docs, counts = len(offsets) - 1, words.counts().astype(float)
    size = np.diff(offsets).astype(float)

    def share(mask: np.ndarray, bounds: np.ndarray, by: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(bounds) - 1), bounds[1:] > bounds[:-1]
        if some.any():
            out[some] = np.add.reduceat(mask, bounds[:-1][some], dtype=np.int64)
        return out / np.maximum(by, 1.0)

    def per_byte(table: np.ndarray) -> np.ndarray:
        return share(table[data], offsets, size)

    last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    before = data[np.maximum(words.end - 2, 0)] if len(words) else last
    # Words that end in two marks, or in one that no prose uses.
    marked = (symbol[last] | (~(letter | digit)[last] & ~(letter | digit)[before])) & (words.end - words.start > 1)
    lone = symbol[last] & (words.end - words.start == 1)
    head = data[words.start] if len(words) else last
    doc = words.document()
    key = words.hash ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n_docs) if len(words) else np.zeros(n_docs)

    # Lines: a line's hash is the sum over its words; repeated lines of one document have equal sums.
    line = np.searchsorted(np.flatnonzero(data == 10), words.start) + doc
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(words) else np.zeros(0, int)
    line_doc = doc[first]
    lines = np.bincount(line_doc, minlength=n_docs).astype(float)
    if len(first):
        line_key = np.add.reduceat(words.hash, first) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kinds = np.bincount(line_doc[np.unique(line_key, return_index=True)[1]], minlength=n_docs)
    else:
        kinds = np.zeros(n_docs)
    spread = np.maximum(counts, 1.0)
    length = np.concatenate([[0], np.cumsum(words.end - words.start)])
    bounds = words.bounds
    out = np.stack(
        [
            np.log1p(counts),
            np.log1p((length[bounds[1:]] - length[bounds[:-1]]) / spread),
            np.sqrt(per_byte(letter)),
            np.sqrt(per_byte(symbol)),
            np.sqrt(per_byte(digit)),
            np.sqrt(per_byte(upper)),
            np.sqrt(share(marked, bounds, counts)),
            # distinct words against the square root of their number: does not just fall with length
            np.log1p(distinct) - 0.8 * np.log1p(counts),
            np.log1p(counts / np.maximum(lines, 1.0)),
            np.sqrt(1.0 - kinds / np.maximum(lines, 1.0)) * (lines > 0),
            np.sqrt(share(lone, bounds, counts)),
            np.sqrt(share(upper[head], bounds, counts)),
        ],
        axis=1,
    )
    return np.nan_to_num(out)


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@dataclass
class QDA:
    """Means, Cholesky factors and log weights of two classes over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray  # 2 x d
    chol: np.ndarray  # 2 x d x d
    weight: np.ndarray  # log prior minus half the log determinant

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, product: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> QDA:
        """From each class's count, sums (2 x d) and sums of products (2 x d x d). A class without rows: no evidence, prior by add-one."""
        d = total.shape[1]
        all_n = max(n.sum(), 1.0)
        centre = total.sum(0) / all_n
        variance = np.diagonal(product.sum(0)) / all_n - centre**2
        scale = np.sqrt(np.maximum(variance, 1e-6))
        mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
        for k in (0, 1):
            if n[k]:
                m = total[k] / n[k]
                mean[k] = (m - centre) / scale
                cov[k] = (product[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        pooled = (n[:, None, None] * cov).sum(0) / all_n
        for k in (0, 1):
            own = n[k] / (n[k] + d) if n.all() else 0.0  # few rows: nearer to the pooled one
            keep = (1 - pool) * own
            cov[k] = keep * cov[k] + (1 - keep) * pooled
            level = max(np.trace(cov[k]) / d, 1e-3)
            cov[k] = (1 - ridge) * cov[k] + ridge * level * np.eye(d)
        chol = np.linalg.cholesky(cov)
        prior = np.log((n + 1) / (n.sum() + 2))
        return cls(centre, scale, mean if n.all() else np.zeros((2, d)), chol, prior - np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = (x - self.centre) / self.scale
        log = []
        for k in (0, 1):
            y = np.linalg.solve(self.chol[k], (z - self.mean[k]).T)
            log.append(self.weight[k] - 0.5 * (y * y).sum(0))
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame, label: str = "label") -> QDA:
    """Fit on all rows of a table with the features and a 0/1 label; other labels and nulls are left out."""
    d = len(FEATURES)
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES))]
    aggs += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {int(r[label]): r for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(*aggs).collect()}
    n, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for k, r in rows.items():
        n[k] = r["n"]
        total[k] = [r[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i + 1):
                product[k, i, j] = product[k, j, i] = r[f"p{i}_{j}"]
    return QDA.fit(n, total, product)


def scored(table: DataFrame, model: QDA) -> DataFrame:
    """``doc_id, score`` for each row of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(1 + j).to_numpy(zero_copy_only=False) for j in range(len(FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    return table.select("doc_id", *FEATURES).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str, modulus: int, remainder: int) -> F.Column:
    """crc32(doc_id as text) mod ``modulus`` = ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, work: Workspace) -> tuple[DataFrame, QDA]:
    """(feature table, model learned from the labelled rows outside the held-out fold).

    A row of ``docs`` learns from each non-null label of its doc_id; rows without a label only get a score.
    """
    table = work.table(feature_table(docs), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label is not null")
    model = fit(table.where(~held_out("doc_id", 5, 0)).join(marks, "doc_id"))
    return table, model


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: ``doc_id, held_out, score, predicted`` (1 from a score of 0.3)."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    table, model = trained(spark, docs, labels, Workspace(spark, "quality"))
    return scored(table, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def sampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QDA:
    """The model learned from the rows of ``docs`` that bear one of at most ``most`` labels outside the held-out fold.

    The labels are those with the smallest hashes of their ids, so the sample is the same however the table is stored.
    They are broadcast; features are computed for the rows that bear them alone, where the rows are.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    drawn = marks.where(~held_out("doc_id", 5, 0)).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id", "label").limit(most)
    few = F.broadcast(drawn.select("doc_id").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi")
    return fit(feature_table(rows).join(F.broadcast(drawn), "doc_id"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns kept.

    Null and empty texts get a score as all others do. The features are computed and scored where the row is, so no
    row is shuffled for its score. ``most``: see :func:`sampled`.
    """
    ship_code(spark)
    return docs.where(score_of(F.col("text").cast("string"), sampled(spark, docs, labels, most)) >= threshold)


def score_of(text: F.Column, model: QDA) -> F.Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(text):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [model.score(features(data, offsets)) for _, _, data, offsets in blocks(pa.array(text, pa.string(), from_pandas=True))]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return score(text)
