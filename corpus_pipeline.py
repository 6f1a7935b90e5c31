"""A cleaning pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``.

Null texts count as empty, null ids are allowed, repeated rows are copies of each other, an empty table stays empty
and further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklith.llm import decontaminate, minhash, packing, quality, substring
from sparklith.llm.storage import Workspace
from sparklith.sources.shared import live, release

#: The documents' quality must be at least this likely.
QUALITY = 0.3
#: Words of a passage that must not stand twice.
PASSAGE = 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled rows outside the held-out fold."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Documents without words all stay."""
    return minhash.keep_one(spark, docs, words=5, percent=80)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``PASSAGE`` words or more that stand at another place, too.

    Texts that lose nothing stay as they are; the others become their kept words, joined by one space.
    """
    cut = substring.cut_rows(spark, docs, PASSAGE)
    lost = F.col("cut.n_removed") > 0
    new = {"text": F.when(lost, F.col("cut.kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("cut.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words in edits."""
    return decontaminate.without_hits(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 4096 token ids."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", unrepeated),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The quality classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    When a stage's table is written, what the stage has left in the shared folder is deleted, and the table before.
    """
    others, work = live(), Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        release(but=others | {work.path})
        if last:
            work.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
