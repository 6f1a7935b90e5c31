"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame, work: Workspace, name: str = "components", rounds: int = 64) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); the root is the smallest node of its component.

    Nodes are of any type that has an order. Each step groups the links by node, takes the smallest neighbour with
    partial aggregation, writes that and joins it back: both sides of the join are plain tables, so Spark can split it
    for a node with very many neighbours. Every round is written, too. Links of a node to itself make a component of one.
    """
    edges = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = _mark(edges)
    for i in range(1, rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lead = work.table(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), f"{name}-lead")
        large = both.where("v >= u").join(lead, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u >= v").distinct()
        large = work.table(large, f"{name}-large")
        lead = work.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lead")
        small = large.join(lead, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
        after = work.table(small, f"{name}-{i}")
        for old in (f"{name}-{i - 1}", f"{name}-lead", f"{name}-large"):
            work.drop(old)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
