"""Ranking-group metadata and label checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.prefix import running_totals


def query_boundaries(df: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, size, first_row, end_row): group i holds rows [first_row, end_row).

    Sizes combine before the shuffle; the running sum over groups is range-partitioned.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    ends = running_totals(sizes, [], [F.col(group)], {"end_row": F.col("size")})
    return ends.select(group, "size", (F.col("end_row") - F.col("size")).alias("first_row"), "end_row")


def query_weights(df: DataFrame, group: str = "group_id", weight: str = "weight") -> DataFrame:
    """Mean row weight per group."""
    return df.groupBy(group).agg(F.avg(weight).alias("query_weight"))


def position_ids(df: DataFrame, position: str = "position") -> DataFrame:
    """Distinct positions with dense zero-based ids. Only the distinct values are numbered."""
    distinct = df.select(position).distinct()
    numbered = running_totals(distinct, [], [F.col(position)], {"n": F.lit(1).cast("bigint")})
    return numbered.select(position, (F.col("n") - 1).alias("position_id"))


def init_scores(df: DataFrame, score: str = "init_score") -> DataFrame:
    return df.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def label_check(
    df: DataFrame, low: float, high: float, label: str = "label", whole: bool = False, gains: int | None = None
) -> DataFrame:
    """One row: min, max and sum of the labels and how many break the rules.

    `whole` asks for non-negative whole numbers below `gains`, as ranking labels must be.
    """
    y = F.col(label)
    outside = (y < low) | (y > high)
    if whole:
        outside = outside | (y != F.floor(y)) | (y < 0)
    if gains is not None:
        outside = outside | (y >= gains)
    return df.agg(
        F.min(y).alias("min"), F.max(y).alias("max"), F.sum(y).alias("sum"), F.count_if(outside).alias("violations")
    )


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def unbalanced_weights(df: DataFrame, label: str = "label") -> tuple[float, float]:
    """Weights (negative, positive) that even out the two classes: the rarer one is raised."""
    n = df.agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg")).first()
    if not n["pos"] or not n["neg"]:
        return 1.0, 1.0
    return (n["pos"] / n["neg"], 1.0) if n["pos"] > n["neg"] else (1.0, n["neg"] / n["pos"])


