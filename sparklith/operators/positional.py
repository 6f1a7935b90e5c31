"""Positions as data: gathering through an index table, composing indexes, zipping columns that were built apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import row_position


def with_position(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """df with a contiguous 0-based position in the order of a unique whole-number column."""
    return row_position(df, order, name=name)


def gather(data: DataFrame, index: DataFrame, pos: str = "pos", at: str = "at") -> DataFrame:
    """Row i of the result is the row of ``data`` at position ``index.at``; ``index`` has ``pos`` and ``at``.

    Positions may repeat, be left out and stand in any order. A position outside the data is an error.
    """
    base = data.withColumnRenamed(pos, at)
    found = index.select(pos, at).join(base.withColumn("_there", F.lit(True)), at, "left")
    inside = F.when(F.col("_there"), F.col(pos)).otherwise(F.raise_error(F.lit("index out of range")).cast("bigint"))
    return found.select(inside.alias(pos), *[c for c in base.columns if c != at])


def re_index(current: DataFrame, index: DataFrame, pos: str = "pos", at: str = "at") -> DataFrame:
    """Compose two indexes: result[i] = current[index[i]]."""
    return gather(current.withColumnRenamed(at, "_to"), index, pos, at).withColumnRenamed("_to", at)


def aligned_zip(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of equal position side by side; an error if a position stands on one side only."""
    l, r = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = l.join(r, pos, "full_outer")
    ok = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col(pos)).otherwise(F.raise_error(F.lit("columns differ in length")).cast("bigint"))
    return both.select(ok.alias(pos), *[c for c in both.columns if c not in (pos, "_l", "_r")])


def length(df: DataFrame) -> DataFrame:
    """Number of rows, as a table of one row."""
    return df.agg(F.count(F.lit(1)).alias("n"))
