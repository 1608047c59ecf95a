"""Row and feature sampling by seeded hashing: repeatable, narrow, and free of order."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.objectives import hash_unit
from paddock.operators.prefix import positions, weighted_percentile

# Default sample size and seeds.
BIN_SAMPLE = 200_000
DATA_SEED, BAGGING_SEED, FEATURE_SEED = 1, 3, 2


def sample_key(row_id: Column, seed: int) -> Column:
    """16 hex digits drawn for a row: the first half of the MD5 of `<row id>/<seed>`; a null id is empty."""
    return F.substring(F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 16)


_DIGITS = 4  # hex digits told apart by one count: 65,536 cells


def top_by_hash(df: DataFrame, k: int | None, seed: int, row_id: str = "row_id") -> DataFrame:
    """k rows (None: all), uniform without replacement: those with the k smallest keys.

    Radix selection: a count of the keys' leading digits shows in which cell the k-th key lies;
    rows of earlier cells are in, and the next digits tell that cell apart, until it
    is wholly in or its keys are. Rows that share the last key are placed by id and
    then by all their columns, by a range-partitioned running count. A pass yields at most 65,536 counts, and no
    task orders the k rows.
    """
    if k is None:
        return df
    keyed = df.withColumn("__u", sample_key(F.col(row_id), seed))
    inside, wanted, prefix = F.lit(False), k, ""
    while len(prefix) < 16:
        cell = F.substring("__u", 1, len(prefix) + _DIGITS)
        cells = keyed.where(F.col("__u").startswith(prefix)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
        counts = sorted((r["cell"], r["n"]) for r in cells.collect())
        if sum(n for _, n in counts) <= wanted:  # only in the first pass: the table has no more rows
            return df
        for at, n in counts:
            if n > wanted:
                break
            wanted -= n
        inside = F.col("__u") < at  # keys before the cell, in the order of their digits
        prefix = at
        if not wanted:
            break
    taken = keyed.where(inside)
    if wanted:
        tied = keyed.where(F.col("__u") == prefix)
        every = [F.col(c) for c in df.columns if c != row_id and not df.schema[c].dataType.typeName() in ("map", "variant")]
        placed = positions(tied, [], [F.col(row_id), *every], "__place")
        taken = taken.unionByName(placed.where(F.col("__place") <= wanted).drop("__place"))
    return taken.drop("__u")


def sample_for_bins(df: DataFrame, k: int | None = BIN_SAMPLE, seed: int = DATA_SEED, row_id: str = "row_id") -> DataFrame:
    """min(n, k) rows to find bins from; None takes all."""
    return top_by_hash(df, k, seed, row_id)


def reservoir_sample(df: DataFrame, k: int, seed: int, where: Column | None = None, row_id: str = "row_id") -> DataFrame:
    """k uniform rows of those that pass `where`; their ids report what was kept."""
    return top_by_hash(df if where is None else df.where(where), k, seed, row_id)


def bag_condition(
    row_id: Column, iteration: int, fraction: float = 1.0, freq: int = 0, seed: int = BAGGING_SEED,
    label: Column | None = None, pos_fraction: float = 1.0, neg_fraction: float = 1.0,
) -> Column | None:
    """Whether a row is in the bag of an iteration; None when bagging is off.

    A bag lasts `freq` iterations. With class fractions, `fraction` is ignored.
    """
    if freq <= 0:
        return None
    u = hash_unit(row_id, seed, iteration // freq)
    if label is not None and (pos_fraction < 1.0 or neg_fraction < 1.0):
        return u < F.when(label > 0, F.lit(pos_fraction)).otherwise(F.lit(neg_fraction))
    return None if fraction >= 1.0 else u < fraction


def bagging(df: DataFrame, iteration: int, fraction: float, freq: int, seed: int = BAGGING_SEED, row_id: str = "row_id") -> DataFrame:
    keep = bag_condition(F.col(row_id), iteration, fraction, freq, seed)
    return df if keep is None else df.where(keep)


def balanced_bagging(
    df: DataFrame, iteration: int, pos_fraction: float, neg_fraction: float, freq: int, seed: int = BAGGING_SEED,
    row_id: str = "row_id", label: str = "label",
) -> DataFrame:
    keep = bag_condition(F.col(row_id), iteration, 1.0, freq, seed, F.col(label), pos_fraction, neg_fraction)
    return df if keep is None else df.where(keep)


def bagging_by_query(df: DataFrame, iteration: int, fraction: float, freq: int, seed: int = BAGGING_SEED, group: str = "group_id") -> DataFrame:
    """Whole groups in or out: the hash is of the group."""
    return bagging(df, iteration, fraction, freq, seed, group)


def goss(
    df: DataFrame, iteration: int, top_rate: float = 0.2, other_rate: float = 0.1, seed: int = BAGGING_SEED,
    row_id: str = "row_id", size: Column | None = None,
) -> DataFrame:
    """Rows with the largest |g * h|, a sample of the rest, and `goss_weight` that makes up
    for the rest that was left out. One job finds the cut; the sampling itself is narrow."""
    return goss_weights(df, iteration, top_rate, other_rate, seed, row_id, size).where("goss_weight IS NOT NULL")


def goss_weights(
    df: DataFrame, iteration: int, top_rate: float = 0.2, other_rate: float = 0.1, seed: int = BAGGING_SEED,
    row_id: str = "row_id", size: Column | None = None,
) -> DataFrame:
    """All rows with their `goss_weight`, which is null for those left out."""
    size = F.abs(F.col("g") * F.col("h")) if size is None else size
    cut = weighted_percentile(df.select(size.alias("value"), F.lit(1.0).alias("weight")), 1.0 - top_rate).first()["value"]
    if cut is None:
        return df.withColumn("goss_weight", F.lit(1.0))
    big = size >= cut
    chance = other_rate / max(1.0 - top_rate, 1e-12)
    keep = big | (hash_unit(F.col(row_id), seed, iteration) < chance)
    weight = F.when(big, F.lit(1.0)).otherwise(F.lit((1.0 - top_rate) / other_rate if other_rate else 0.0))
    return df.withColumn("goss_weight", F.when(keep, weight))


def feature_sample(features: list[str], fraction: float, seed: int, *path: int) -> list[str]:
    """A seeded subset of the features, at least one; `path` names the tree or node."""
    if fraction >= 1.0:
        return list(features)
    picked = random.Random(f"{seed}/{'/'.join(map(str, path))}").sample(range(len(features)), max(1, round(len(features) * fraction)))
    return [features[i] for i in sorted(picked)]
