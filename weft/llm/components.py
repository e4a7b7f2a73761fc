"""Connected components of a graph that is given by its edges, by alternating large and small stars.

Each round links nodes to the smallest node around them: a large star moves larger neighbours of a node, a small
star its smaller ones. Only minima are aggregated and joined back, so neighbours of a node never meet in a list and a node with
very many edges is dealt with by partial aggregation and Spark's skew joins. Every half round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, each node of the star linked to the star's minimum."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(flipped) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    met = around.join(least, F.col("u") == F.col("_u"))
    moved = met.where(F.col("v") > F.col("u")) if large else met
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that it can reach, for every node with an edge to another.

    ``edges`` has two columns of one type, in either direction, repeated or from a node to itself as they come; a null end makes no link.
    """
    a, b = edges.columns
    found = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    found = written(found.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        found = written(_stars(written(_stars(found, True), "large-star"), False), "small-star")
        now = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
