"""Connected components of a graph kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so the number of rounds grows
    with the logarithm of the graph. Each round is a checkpoint in the shared folder; nothing but a count and
    a sum reaches the driver. Loops, repeated and reversed edges and edges with a null end are harmless:
    loops and nulls drop, so a node whose only edge is a loop is not returned. No edges give no rows.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
        .checkpoint()
    )
    mark = None
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    leaves = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return leaves.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = ends.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    return ends.where("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges come as (smaller u, larger v)."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    tied = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return tied.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()
