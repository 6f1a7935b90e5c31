"""Null-propagating scalar operators over columns of a DataFrame. NULL on either side gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import DECIMAL_U64, number, unsigned_add


def _operands(df: DataFrame, a: str | Column, b: str | Column) -> tuple[Column, Column, object, object]:
    x, y = (F.expr(c) if isinstance(c, str) else c for c in (a, b))
    kinds = df.select(x.alias("a"), y.alias("b")).schema
    return x, y, kinds[0].dataType, kinds[1].dataType


def add(df: DataFrame, a: str | Column, b: str | Column, overflow: str = "error") -> Column:
    """a + b in the wider type; a boolean counts as 0 or 1. ``overflow``: "error", or "null" for NULL instead."""
    x, y, s, t = _operands(df, a, b)
    if s == DECIMAL_U64 and t == DECIMAL_U64:
        return unsigned_add(x, y)
    x, y = number(x, s), number(y, t)
    if overflow == "null":
        return F.try_add(x, y)
    if overflow != "error":
        raise ValueError(f"overflow: {overflow}")
    return x + y


def _compared(df: DataFrame, a: str | Column, b: str | Column) -> tuple[Column, Column]:
    x, y, s, t = _operands(df, a, b)
    return (x, y) if s == t else (number(x, s), number(y, t))


def eq(df: DataFrame, a: str | Column, b: str | Column) -> Column:
    x, y = _compared(df, a, b)
    return x == y


def gt(df: DataFrame, a: str | Column, b: str | Column) -> Column:
    x, y = _compared(df, a, b)
    return x > y


def ge(df: DataFrame, a: str | Column, b: str | Column) -> Column:
    x, y = _compared(df, a, b)
    return x >= y


def constant(value: object) -> Column:
    """A bound constant in an expression."""
    return F.lit(value)
