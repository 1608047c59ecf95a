"""Equi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# By default Spark's own skew handling splits hot partitions at run time. A number of rows
# makes keys above it salted instead, at the price of counting the keys first.
HOT_ROWS: int | None = None
SALTS = 32


def skewed_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_rows: int | None = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join `many` (any number of rows per key) to `one` (few rows per key) on `keys`.

    Without `hot_rows` this is a plain join, whose hot partitions adaptive execution splits.
    With it, keys of `many` with more than `hot_rows` rows are split over `salts` tasks, and
    only the rows of `one` with such a key are repeated; Spark picks how the list of such keys
    is joined.
    """
    if hot_rows is None:
        return many.join(one, keys, how)
    hot = many.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys, F.lit(True).alias("__hot"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns], F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    salted = many.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))
    ).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = one.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
