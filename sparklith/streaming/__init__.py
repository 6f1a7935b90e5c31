"""The row-wise operators on streams: they hold no state, so a stream is projected and bucketed like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparklith.operators.partitioning import with_bucket
from sparklith.plans.sql import project


def project_stream(stream: DataFrame, expression: str, name: str = "out") -> DataFrame:
    """A projection of a streaming DataFrame."""
    return project(stream, expression, name)


def bucket_stream(stream: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bucket numbers for a streaming DataFrame."""
    return with_bucket(stream, keys, bits)
