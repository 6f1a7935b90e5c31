"""Roles of column types and how operands combine.

A role is what an operand counts as in the strict grammar and in the registry: ``u64 usize u32 u16 u8 bool str``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark type of each role when a column is made; unsigned 64-bit values stay below 2**63 unless DECIMAL_U64 is asked for.
SPARK_TYPE: dict[str, T.DataType] = {
    "u64": T.LongType(),
    "usize": T.LongType(),
    "u32": T.LongType(),
    "u16": T.IntegerType(),
    "u8": T.ShortType(),
    "bool": T.BooleanType(),
    "str": T.StringType(),
}
DECIMAL_U64 = T.DecimalType(20, 0)
U64_LIMIT = 1 << 64

#: Operand pairs of the numeric kernels; the result of an addition has the left one's role.
ASSIGN_PAIRS = [("u64", "u64"), ("u64", "u32"), ("u64", "u16"), ("u64", "u8"), ("u64", "bool"), ("u32", "u32")]
PAIRS = [*ASSIGN_PAIRS, ("usize", "usize")]


def role_of(kind: T.DataType) -> str:
    """The role that a column of existing data plays."""
    if isinstance(kind, T.LongType) or kind == DECIMAL_U64:
        return "u64"
    for t, role in ((T.IntegerType, "u32"), (T.ShortType, "u16"), (T.ByteType, "u8"), (T.BooleanType, "bool"), (T.StringType, "str"), (T.BinaryType, "str")):
        if isinstance(kind, t):
            return role
    raise ValueError(f"no role for {kind.simpleString()}")


def number(col: Column, kind: T.DataType) -> Column:
    """Booleans as 0 and 1, so that they can be added to and compared with numbers."""
    return col.cast("bigint") if isinstance(kind, T.BooleanType) else col


def unsigned_add(a: Column, b: Column) -> Column:
    """Sum of two decimal(20,0) columns, an error from 2**64 on."""
    total = (a.cast("decimal(21,0)") + b.cast("decimal(21,0)")).cast("decimal(22,0)")
    over = F.raise_error(F.lit("unsigned 64-bit overflow")).cast(DECIMAL_U64)
    return F.when(total >= F.lit(str(U64_LIMIT)).cast("decimal(22,0)"), over).otherwise(total.cast(DECIMAL_U64))
