"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (a, b) of longs.

    Alternating star contraction: every node's larger neighbours move to its smallest neighbour,
    then its smaller neighbours do; edge counts never grow, hubs are joined with one row per node,
    and the number of rounds is logarithmic. Each round is written to the shared folder."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        f"{label}-edges")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = materialise(both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("m").alias("a"), "b")
                            .where("a <> b").distinct(), f"{label}-large")
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        moved = large.join(low, large["b"] == low["k"]).select(F.col("m").alias("a"), F.col("a").alias("b"))
        kept = low.select(F.col("m").alias("a"), F.col("k").alias("b"))
        edges = materialise(moved.unionByName(kept).where("a <> b").distinct(), f"{label}-small")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one root, which is none's leaf (edges a < b)."""
    role = edges.select(F.col("a").alias("v"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("v"), F.lit(1).alias("leaf")))
    mixed = role.groupBy("v").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).where("n > 1 or (n = 1 and least = 0)")
    return mixed.limit(1).count() == 0
