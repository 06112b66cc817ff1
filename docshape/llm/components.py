"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _stars(edges: DataFrame, keep, include_self: bool) -> DataFrame:
    """For each node u, links its neighbours that ``keep`` selects (and u) to the least of them and u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("k"))
    out = joined.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if include_self:
        out = out.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, and the least node that it reaches.

    ``edges`` holds orderable ids; loops, repeats and null ends are harmless (a null end is no edge).
    Work per round is a few shuffles of the edges; rounds grow with the logarithm of the longest chain.
    Each round's edges go to the shared checkpoint folder; only a count and a digest come to the driver."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        digest = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("d")).first()
        if digest == seen or not digest["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        seen = digest
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both, F.col("v") > F.col("u"), include_self=False)
        # Large-star keeps a node's own link to its least neighbour: (v, m) for v > u covers it from the other end.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = checkpoint(_stars(down, F.col("v") < F.col("u"), include_self=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
