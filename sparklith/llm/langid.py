"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams in order of frequency. A document's own most frequent n-grams are
held against each profile by the out-of-place distance: the sum over them of how far the ranks are apart, or of the
largest distance where the profile lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import held_out
from .storage import ship_code

GRAMS = 3
PROFILE = 400
#: Characters of one text that are counted at a time; the counts are merged.
CHUNK = 1 << 20
GAP = np.uint64(0x1FFFFF)


def letters(text: str) -> np.ndarray:
    """Lower-case code points of the letters; every run of anything else as one gap."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else code
    table = np.full(int(kinds[-1]) + 1 if len(kinds) else 1, 0x1FFFFF, np.uint32)
    for c in kinds.tolist():
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    out = table[code]
    keep = out != 0x1FFFFF
    keep[1:] |= keep[:-1].copy()  # the first of a run of others stands for it
    keep[:1] = True
    return out[keep].astype(np.uint64)


def gram_counts(text: str, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text for n up to ``grams`` (at most 3), in ascending order of the packed n-gram.

    A gap stands before and after the text. It is worked on ``CHUNK`` characters at a time.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before, some = np.array([GAP]), False
    for at in range(0, len(text), CHUNK):
        part = letters(text[at : at + CHUNK])
        if before[-1] == GAP and part[0] == GAP:
            part = part[1:]
        if at + CHUNK >= len(text) and (part[-1] if len(part) else before[-1]) != GAP:
            part = np.append(part, GAP)
        if not len(part):
            continue
        own = part[part != GAP]
        some |= len(own) > 0
        line, keys = np.concatenate([before, part]), [own]
        for n in range(2, grams + 1):
            packed = line[max(0, len(before) - n + 1) : len(line) - n + 1]
            for j in range(1, n):
                packed = (packed << np.uint64(21)) | line[max(0, len(before) - n + 1) + j :][: len(packed)]
            keys.append(packed)
        found.append(np.unique(np.concatenate(keys), return_counts=True))
        before = line[-max(grams - 1, 1) :]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    return merge(found)


def merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)


@dataclass
class Profiles:
    """All languages' n-grams in ascending order, and each one's rank in each language (``size`` where it has none)."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray  # keys x languages
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """rows: (language, n-gram as a signed 64-bit number, rank from 0)."""
        languages = sorted({r[0] for r in rows})
        grams = np.array([r[1] for r in rows], np.int64).astype(np.uint64)
        keys = np.unique(grams)
        ranks = np.full((len(keys), max(len(languages), 1)), size, np.int64)
        place = {x: i for i, x in enumerate(languages)}
        ranks[np.searchsorted(keys, grams), [place[r[0]] for r in rows]] = [r[2] for r in rows]
        return cls(languages, keys, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): one minus the share of the largest possible distance. Ties: the language first in order."""
        if text is None or not self.languages:
            return "und", 0.0
        keys, counts = gram_counts(text)
        if not len(keys):
            return "und", 0.0
        top = keys[np.argsort(-counts, kind="stable")[: self.size]]
        slot = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        there = self.keys[slot] == top
        ranks = self.ranks[slot]
        away = np.where(there[:, None] & (ranks < self.size), np.abs(ranks - np.arange(len(top))[:, None]), self.size)
        distance = away.sum(0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(top)))


def learn(spark: SparkSession, docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of every non-null ``lang`` in ``docs`` (text, lang), from the counts over all its whole texts.

    Each task adds up its own rows first, so a language shuffles a row for each task and n-gram at most. What comes
    to the driver is ``size`` rows a language. An n-gram of frequency equal to another's goes by its code.
    """
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                mine = held.setdefault(lang.as_py(), [])
                mine.append(gram_counts(text.as_py()))
                if len(mine) >= 256:
                    held[lang.as_py()] = [merge(mine)]
        for lang, found in held.items():
            keys, counts = merge(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    total = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")).alias("r")
    best = total.select("lang", "gram", rank).where(F.col("r") <= size).collect()
    return Profiles.of([(r["lang"], r["gram"], r["r"] - 1) for r in best], size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs`` (doc_id, text). Null text, or none with a letter: ``und``, 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [profiles.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the fold of crc32 mod 4 = 2: ``doc_id, held_out, lang_pred, score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(spark, docs.where(~held_out("doc_id", 4, 2)))
    return predict(docs, profiles).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
