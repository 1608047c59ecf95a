"""Running totals over groups of any size.

A plain window puts a whole group (or, without a group, the whole table) into one task.
Here rows are range-partitioned on group and order together, so a hot group spreads over
many partitions; each partition keeps its own running total and learns its offset from a
small table of per-partition totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.session import cut_lineage, parallelism

SLICE = "__slice"


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    totals: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add one inclusive running total per entry of `totals`, in `order` within `group`.

    `order` must be total within a group for a repeatable result. The range-partitioned
    rows are checkpointed before they are read twice, which freezes the slice ids.
    """
    spark = df.sparkSession
    n = partitions or parallelism(spark)
    staged = df.select("*", *[c.alias(f"__in_{name}") for name, c in totals.items()])
    ranged = staged.repartitionByRange(n, *[F.col(g) for g in group], *order)
    frozen = cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))
    # At most `n` slices per group, so the window below sees at most `n` rows per group.
    sums = frozen.groupBy(*group, SLICE).agg(*[F.sum(f"__in_{t}").alias(f"__sum_{t}") for t in totals])
    before = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"__g_{g}") for g in group],
        F.col(SLICE).alias("__offset_slice"),
        *[F.coalesce(F.sum(f"__sum_{t}").over(before), F.lit(0)).alias(f"__off_{t}") for t in totals],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group],
        F.col(SLICE) == F.col("__offset_slice"),
    )
    joined = frozen.join(offsets, same, "inner")
    within = W.partitionBy(SLICE, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *[(F.col(f"__off_{t}") + F.sum(f"__in_{t}").over(within)).alias(t) for t in totals],
    )


def sorted_slices(df: DataFrame, group: list[str], order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows range-partitioned on group and order and sorted so within their partition, whose number is added; frozen."""
    keys = [*[F.col(g) for g in group], *order]
    ranged = df.repartitionByRange(partitions or parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """One-based position of each row in its group, for groups of any size."""
    return running_totals(df, group, order, {name: F.lit(1).cast("bigint")})


def first_rows(df: DataFrame, key: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first `count` rows per key.

    Filtering a row number lets Spark cut every group to `count` rows before the shuffle
    (window group limit), so a hot key sends only `count` rows per map task.
    """
    window = W.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(window))
        .where(F.col("__rank") <= count)
        .drop("__rank")
    )


def weighted_percentile(df: DataFrame, share: float, value: str = "value", weight: str = "weight") -> DataFrame:
    """One row (value): the smallest value up to which `share` of all weight lies, exactly.

    Equal values are combined first, so only distinct values are put in order.
    """
    combined = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.sum(weight).alias("weight"))
    upto = running_totals(combined, [], [F.col("value")], {"upto": F.col("weight")})
    total = upto.agg(F.sum("weight").alias("total"))
    reached = F.col("upto") >= F.col("total") * (share - 1e-12)
    return upto.join(F.broadcast(total)).agg(F.min(F.when(reached, F.col("value"))).alias("value"))  # total is one row
