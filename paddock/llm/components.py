"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node and a join, so no neighbourhood is ever held in one place;
a hub with a large share of all edges is combined before the shuffle and its join is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.tables import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u, v) with u > v, relinked to the smallest neighbour of their centre.

    Large-star hangs a node's larger neighbours under the smallest of all its neighbours and
    itself; small-star hangs a node and its smaller neighbours under the smallest of them.
    """
    if larger:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        below = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = below.unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one root that hangs under nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    sides = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sides.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node it reaches."""
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    while not _is_forest_of_stars(now):
        now = stored(_star(_star(now, True), False).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
