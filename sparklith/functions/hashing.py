"""Row hashes that keep NULLs: NULL if any key is NULL, so that no real hash can stand for a missing one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BITS = 62


def row_hash(*cols: str | Column) -> Column:
    """A 64-bit hash of the columns in their order."""
    if not cols:
        raise ValueError("a hash needs a column")
    keys = [F.col(c) if isinstance(c, str) else c for c in cols]
    valid = reduce(lambda x, y: x & y, (k.isNotNull() for k in keys))
    return F.when(valid, F.xxhash64(*keys))


def bucket_id(hash_: str | Column, bits: int) -> Column:
    """Bucket of a hash among 2**bits; a NULL hash goes to the last one."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"too many buckets: 2**{bits}")
    h = F.col(hash_) if isinstance(hash_, str) else hash_
    n = 1 << bits
    return F.coalesce(F.pmod(h.cast("bigint"), F.lit(n)), F.lit(n - 1)).cast("bigint")
