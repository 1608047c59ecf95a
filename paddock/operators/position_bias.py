"""Position bias of a ranker: one factor per position, learned beside the trees.

A row that was shown at a better place is picked partly for that place. The ranking loss is
therefore read at score + factor of the row's position, so that trees explain only what
positions do not. After a round's gradients, each factor takes one Newton step on the same loss
with the penalty regularization / 2 * rows * factor^2:

    factor - rate * (sum g + regularization * rows * factor) / (sum h + regularization * rows + DAMPING)

Only differences within a group matter to the loss, so factors are known up to a constant.
Predictions use the trees alone.

A row with a null position has factor 0 and moves none. A position without a row in `graded` keeps
its factor. Factors are as many as there are distinct positions, which may be as many as the rows
of the largest group: they are broadcast only up to `BROADCAST_POSITIONS`, and sums combine per
task before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.session import cut_lineage

# What keeps a step finite where no row of a position has curvature, and the number of
# factors (some tens of bytes each) that may be broadcast.
DAMPING = 1e-3
BROADCAST_POSITIONS = 100_000


class PositionFactors:
    """A table (position, factor) and how many rows it has."""

    def __init__(self, table: DataFrame):
        """`table` must not change between reads: positions are counted here and read again later."""
        self.table = table
        self.small = table.count() <= BROADCAST_POSITIONS

    @classmethod
    def zeros(cls, rows: DataFrame, position: str = "position") -> PositionFactors:
        """Factor 0 for every position of the rows."""
        known = rows.select(F.col(position).alias("position")).where(F.col("position").isNotNull()).distinct()
        return cls(cut_lineage(known.select("position", F.lit(0.0).alias("factor"))))

    def added_to(self, rows: DataFrame, score: str = "score", position: str = "position") -> DataFrame:
        """The same rows and columns, their scores raised by the factors of their positions."""
        found = self.table.select(F.col("position").alias("__position"), F.col("factor").alias("__factor"))
        met = rows.join(F.broadcast(found) if self.small else found, F.col(position) == F.col("__position"), "left")
        raised = (F.col(score) + F.coalesce("__factor", F.lit(0.0))).alias(score)
        return met.select(*[raised if c == score else F.col(f"`{c}`") for c in rows.columns])

    def stepped(
        self, graded: DataFrame, rate: float, regularization: float = 0.0, g: Column | None = None, h: Column | None = None,
        position: str = "position",
    ) -> PositionFactors:
        """The factors after one Newton step on rows with gradients; rows whose g is null take no part."""
        g = F.col("g") if g is None else g
        h = F.col("h") if h is None else h
        held = graded.select(F.col(position).alias("position"), g.alias("g"), h.alias("h")).where("position IS NOT NULL AND g IS NOT NULL")
        sums = held.groupBy("position").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
        pull = regularization * F.col("n")
        step = rate * (F.col("g") + pull * F.col("factor")) / (F.col("h") + pull + DAMPING)
        moved = self.table.join(sums, "position", "left").select("position", (F.col("factor") - F.coalesce(step, F.lit(0.0))).alias("factor"))
        return PositionFactors(cut_lineage(moved))
