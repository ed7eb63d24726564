"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of `edges` (a, b).

    Null ends and self-loops are left out; repeated edges do not matter. Each round stores
    the edges, so that its lineage stays short; the rounds grow with the logarithm of the
    size of the largest component. They end when only stars are left, which a further round
    would not change.
    """
    ordered = edges.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = stored(ordered.distinct(), "edges")
    while not _only_stars(now):
        now = stored(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _only_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is the larger end of no edge."""
    larger = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    smaller = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = larger.unionByName(smaller).groupBy("node")
    ends = nodes.agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR (up = 1 AND down = 1)").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the least node around it.

    As many rows as there are edges; the small star takes repeated ones out.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.filter("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
