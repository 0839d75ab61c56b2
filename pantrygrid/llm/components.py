"""Connected components of a graph held as rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import shared


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and those that have one are nobody's."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) of every node of edges (a, b: long).

    Each round is two joins of the edges with one least neighbour for each node; rounds grow with the logarithm of the
    size of a component. Every round is written to the shared folder, and so is the result, so that the driver never holds
    the plans and tasks of more than one step. A row of a join gives one edge at most. A node with very many links is one
    row after a partial minimum.
    """
    now = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours go under the least one, and so does the node itself by the row of that neighbour.
        large = shared.written(both.join(least, "a").where("b > a or b = m").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        now = shared.written(small.where("a <> b").distinct())
    return shared.written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def contracted(groups: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of what groups (node, component) and links (a, b) between their components, or nodes in none, connect."""
    outer = components(links)
    alone = outer.join(groups, "node", "left_anti").select("node", F.col("node").alias("component"))
    further = outer.select(F.col("node").alias("component"), F.col("component").alias("outer"))
    return groups.unionByName(alone).join(further, "component", "left").select("node", F.coalesce("outer", "component").alias("component"))
