"""Connected components by alternating large-star and small-star steps over a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import materialize, release


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has at most one edge out, and none that leads on."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's least neighbour, itself included."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pairs = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) of comparable ids to (node, component): each linked node with the least id it reaches.

    Works by aggregates and joins only, so a node with very many links is summed before it is
    shuffled; every round is stored, so a lost executor repeats one round at most. Self-links and
    null ends are ignored; repeated links do no harm; no links give no rows.
    """
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(down, "edges")
    while not _is_forest(edges):
        edges, old = materialize(_small(_large(edges)), "edges"), edges
        release(old)
    # every remaining edge leads to a root; roots themselves are their components
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
