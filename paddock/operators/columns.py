"""Column and row housekeeping on feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.operators.prefix import positions, running_totals

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)


def nulls_to_nan(df: DataFrame, features: list[str]) -> DataFrame:
    """Numeric and boolean columns as doubles: null becomes NaN in floating columns and 0 in
    the others. Any other type is refused."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def widened(name: str) -> Column:
        kind = types[name]
        if not isinstance(kind, _NUMBERS):
            raise TypeError(f"column {name} of type {kind.simpleString()} is not numeric")
        empty = float("nan") if isinstance(kind, (T.FloatType, T.DoubleType)) else 0.0
        return F.coalesce(F.col(name).cast("double"), F.lit(empty)).alias(name)

    return df.select(*[widened(c) if c in features else F.col(c) for c in df.columns])


def concat_matrices(parts: list[DataFrame]) -> DataFrame:
    """Rows of several matrices with the same columns, appended."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def sparse_to_dense(triples: DataFrame, features: list[str]) -> DataFrame:
    """(row_id, feature, value) to one column per feature: absent is 0.0, a feature index
    out of range is ignored, and of repeated entries the largest stays.

    One conditional aggregate per feature combines before the shuffle, so a row with very
    many entries costs no more than any other.
    """
    return triples.groupBy("row_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("feature") == i, F.col("value"))), F.lit(0.0)).alias(name)
            for i, name in enumerate(features)
        ]
    )


def feature_ranges(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, min, max, distinct) in one pass over the rows."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.min(F.nanvl(F.col(f), F.lit(None).cast("double"))).alias("min"),
                F.max(F.nanvl(F.col(f), F.lit(None).cast("double"))).alias("max"),
                F.count_if(F.isnan(f)).alias("missing"),
                F.count(F.lit(1)).alias("rows"),
            ).alias(f"s{i}")
            for i, f in enumerate(features)
        ]
    )
    return stats.select(F.inline(F.array(*[f"s{i}" for i in range(len(features))])))


def drop_constant_features(df: DataFrame, features: list[str], min_rows: int = 0) -> DataFrame:
    """(feature, keep): whether a feature has two values and, with `min_rows`, a cut that
    leaves at least that many rows on each side.

    Values combine per feature first; their running counts are range-partitioned.
    """
    if min_rows <= 0:
        ranges = feature_ranges(df, features)
        spread = (F.col("min") < F.col("max")) | ((F.col("missing") > 0) & (F.col("missing") < F.col("rows")))
        return ranges.select("feature", F.coalesce(spread, F.lit(False)).alias("keep"))
    counts = unpivot(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(counts, ["feature"], [F.col("value")], {"upto": F.col("n")})
    sizes = upto.groupBy("feature").agg(F.sum("n").alias("rows"))
    parted = (F.col("upto") >= min_rows) & (F.col("rows") - F.col("upto") >= min_rows)
    both = upto.join(F.broadcast(sizes), "feature")  # one row per feature column
    return both.groupBy("feature").agg(F.max(parted).alias("keep"))


def unpivot(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep, feature, value) rows from feature columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(pairs))


def feature_infos(df: DataFrame, numeric: list[str], categorical: DataFrame | None = None) -> DataFrame:
    """(feature, info): `[min:max]` of a numeric feature, the categories in bin order joined
    by `:` of a categorical one, `none` for a feature with one value.

    `categorical` is a bin table (feature, bin, category), at most the bin limit per feature.
    """
    # Adding zero turns a negative zero into a plain one.
    ends = [(F.col(c) + 0.0).cast("string") for c in ("min", "max")]
    shown = F.concat(F.lit("["), ends[0], F.lit(":"), ends[1], F.lit("]"))
    info = F.when(F.col("min") < F.col("max"), shown).otherwise(F.lit("none"))
    out = feature_ranges(df, numeric).select("feature", info.alias("info"))
    if categorical is None:
        return out
    listed = F.sort_array(F.collect_list(F.struct("bin", "category")))
    joined = F.array_join(F.transform(listed, lambda s: s["category"].cast("string")), ":")
    named = categorical.where("category >= 0").groupBy("feature").agg(
        F.when(F.count(F.lit(1)) > 1, joined).otherwise(F.lit("none")).alias("info")
    )
    return out.unionByName(named)


def row_subset(df: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows whose id is in `rows`."""
    return df.join(rows.select(row_id), row_id, "left_semi")


def add_feature_columns(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Append another table's columns, aligned by row id."""
    return left.join(right, row_id, "inner")


def stable_sort_pairs(pairs: DataFrame, descending: bool = False, start: int = 0) -> DataFrame:
    """Pairs (key, value, at) with a final position `pos`: rows from position `start` on are
    sorted by key, equal keys keeping their order; earlier rows stay where they are.

    Positions come from the range-partitioned running count, not from one global window.
    """
    key = F.col("key").desc() if descending else F.col("key").asc()
    if start <= 0:
        return positions(pairs, [], [key, F.col("at")], "pos")
    placed = positions(pairs, [], [F.col("at")], "pos")
    head = placed.where(F.col("pos") <= start)
    tail = placed.where(F.col("pos") > start).drop("pos")
    return head.unionByName(
        positions(tail, [], [key, F.col("at")], "pos").withColumn("pos", F.col("pos") + start)
    )
