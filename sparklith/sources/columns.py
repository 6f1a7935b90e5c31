"""Columns from memory and tables from Parquet; typed access to results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklith.functions.types import SPARK_TYPE, role_of
from sparklith.functions.validity import with_validity


def column(spark: SparkSession, values: Iterable, role: str = "u64", name: str = "value", valid: Iterable[int] | None = None) -> DataFrame:
    """A column in memory with positions from 0; where ``valid`` is 0 the value is NULL. An error if lengths differ."""
    data = list(values)
    flags = list(valid) if valid is not None else [1] * len(data)
    if len(flags) != len(data):
        raise ValueError("validity and data differ in length")
    schema = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField(name, SPARK_TYPE[role])])
    return spark.createDataFrame([(i, v if f else None) for i, (v, f) in enumerate(zip(data, flags))], schema)


def strings(spark: SparkSession, values: Iterable[str | None], name: str = "value", valid: Iterable[int] | None = None) -> DataFrame:
    return column(spark, values, "str", name, valid)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(df: DataFrame, old: str, new: str) -> DataFrame:
    """Attach a name to a column."""
    return df.withColumnRenamed(old, new)


def slice_rows(df: DataFrame, start: int, end: int, pos: str = "pos") -> DataFrame:
    """Rows start..end-1 with positions from 0 again."""
    return df.where((F.col(pos) >= start) & (F.col(pos) < end)).withColumn(pos, F.col(pos) - start)


def attach_validity(df: DataFrame, name: str, flag: str) -> DataFrame:
    """NULL where the flag column is 0; the flag itself is dropped."""
    return df.withColumn(name, with_validity(F.col(name), F.col(flag))).drop(flag)


def view(df: DataFrame, name: str) -> DataFrame:
    """The table under a name that SQL can use; nothing is copied."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def described(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``name, role, indexed, n, valid`` for each column: what it is, whether positions stand beside it, rows and rows that are not NULL."""
    names = [c for c in (columns or df.columns) if c != "pos"]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)))
    rows = [F.struct(F.lit(c).alias("name"), F.lit(role_of(df.schema[c].dataType)).alias("role"), F.lit("pos" in df.columns).alias("indexed"), F.col("n"), F.col(f"v{i}").alias("valid")) for i, c in enumerate(names)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def take(df: DataFrame, name: str, role: str | None = None, pos: str = "pos") -> list:
    """A column's values in order, on the driver: for small results. With a role, an error if the type is another one."""
    kind = df.schema[name].dataType
    if role is not None and kind != SPARK_TYPE[role]:
        raise TypeError(f"{name} is {kind.simpleString()}, not {role}")
    return [r[0] for r in df.orderBy(pos).select(name).collect()]


def write_table(df: DataFrame, path: str, bucket: str | None = None) -> None:
    """Write as Parquet, in a folder a bucket if a bucket column is named."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(bucket) if bucket else writer).parquet(path)
