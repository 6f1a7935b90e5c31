"""Prefix sums and row numbers in two phases, so that no task sees all rows.

Rows are dealt by their order into ranges of about equally many rows, whatever the keys are, sorted inside each and
written once; so the ranges are the same wherever they are read. A row's number inside its range is known when it is
written. Range totals are one small aggregate; their running sum, a window over the ranges alone, is added to what a row
has inside its range. A table of one range needs none of this: it is one window, over CHUNK rows at most.

Every range is a task, a file and a row of the totals, so a table has MOST_RANGES of them at most; where ranges of the
size asked for would be more, they are larger, but not beyond CHUNK rows: a table of more than that has more ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklith.sources.shared import Workspace

#: Rows of a range, about; ranges of a table whose ranges have fewer rows; ranges whose totals are broadcast (16 bytes each).
CHUNK, MOST_RANGES, MOST_BROADCAST = 1 << 20, 256, 1 << 20


def _keys(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def _ranges(df: DataFrame, order: list[str], chunk: int) -> tuple[DataFrame, int]:
    """(df with ``_chunk``, its range in the order, and ``_row``, its number in that; the number of ranges). NULLs come first.

    Rows that fit one range come back as they are.
    """
    if chunk < 1 or chunk & (chunk - 1):
        raise ValueError("a chunk's size is a power of two")
    n = df.count()
    parts = max(1, min(-(-n // chunk), max(MOST_RANGES, -(-n // CHUNK))))
    if parts == 1:
        return df, 1
    keys = _keys(order)
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = rows.withColumns({"_chunk": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    return Workspace(df.sparkSession, "ranges").table(rows, "rows"), parts


def _with_before(rows: DataFrame, parts: int, total: Column) -> DataFrame:
    """rows with ``_before``: the sum of ``total`` over all earlier ranges; NULL if they have none."""
    sums = rows.groupBy("_chunk").agg(total.alias("_sum"))
    # A row per range: the one place where a window has no partition.
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_chunk", F.sum("_sum").over(earlier).alias("_before"))
    return rows.join(F.broadcast(before) if parts <= MOST_BROADCAST else before, "_chunk")


def _at(rows: DataFrame, parts: int, name: str) -> DataFrame:
    at = (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("bigint")
    return _with_before(rows, parts, F.count(F.lit(1))).withColumn(name, at).drop("_chunk", "_row", "_before")


def _numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*_keys(order))) - 1).cast("bigint"))


def row_position(df: DataFrame, order: str, by: list[str] | None = None, name: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """df with each row's position from 0 in the order (by, order). ``order``: unique, of any type that has an order."""
    keys = [*(by or []), order]
    rows, parts = _ranges(df, keys, chunk)
    return _at(rows, parts, name) if parts > 1 else _numbered(df, [], keys, name)


def position_within(df: DataFrame, by: list[str], order: str | list[str], name: str = "pos_in", chunk: int = CHUNK) -> DataFrame:
    """df with each row's position from 0 among the rows of equal ``by``, NULLs being equal, in the order of ``order``.

    In several ranges that is its position among all less that of the first row of equal ``by``.
    """
    within = [order] if isinstance(order, str) else order
    rows, parts = _ranges(df, [*by, *within], chunk)
    if parts == 1:
        return _numbered(df, by, within, name)
    rows = _at(rows, parts, "_at")
    first = rows.groupBy(*by).agg(F.min("_at").alias("_first")).withColumnsRenamed({c: f"_key{i}" for i, c in enumerate(by)})
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by)))
    out = rows.join(first, on).withColumn(name, F.col("_at") - F.col("_first"))
    return out.drop("_at", "_first", *(f"_key{i}" for i in range(len(by))))


def _one_window(df: DataFrame, value: str, order: str, start: int, name: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w) + F.lit(start))


def prefix_sum(df: DataFrame, value: str, order: str, start: int = 0, name: str = "prefix", by: list[str] | None = None) -> DataFrame:
    """Inclusive running sum plus ``start``. NULL up to the first value.

    With ``by`` it is one window, for partitions that fit a task; without, a table of more than CHUNK rows is summed in
    two phases. ``order``: unique.
    """
    return _one_window(df, value, order, start, name, by) if by else prefix_sum_parallel(df, value, order, start, name, CHUNK)


def prefix_sum_parallel(df: DataFrame, value: str, order: str, start: int = 0, name: str = "prefix", chunk: int = CHUNK) -> DataFrame:
    """The same in two phases, for tables of any size, NULLs included. ``order``: unique. Empty in, empty out."""
    rows, parts = _ranges(df, [order], chunk)
    if parts == 1:
        return _one_window(df, value, order, start, name, [])
    inside = F.sum(value).over(Window.partitionBy("_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = _with_before(rows, parts, F.sum(value)).withColumn("_inside", inside)
    total = F.coalesce(F.col("_inside") + F.col("_before"), F.col("_inside"), F.col("_before"))
    return joined.withColumn(name, total + F.lit(start)).drop("_chunk", "_row", "_before", "_inside")
