"""Validity flags and NULLs: a row is valid if its flag is not 0, and an invalid row's value is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_validity(col: Column, flag: Column) -> Column:
    """The value where the flag is neither 0 nor NULL, else NULL."""
    return F.when(flag.cast("bigint") != 0, col)


def is_valid(col: Column) -> Column:
    return col.isNotNull()


def both_valid(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def either_valid(a: Column, b: Column) -> Column:
    return a.isNotNull() | b.isNotNull()


def same_validity(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column tables of flags hold equal numbers of equal rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
