"""Training on (row_id, feature, value) triples without ever making a row as wide as the features.

A row is a map from feature number to bin of its stored values only; every other feature is in its
zero bin. Histograms sum the stored bins, and a zero bin is the node's total less the
feature's other bins, so work grows with the stored values and not with rows times features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.binning import FeatureBins, collect_spec, find_numeric_bins


def _whole(triples: DataFrame, features: int) -> DataFrame:
    """One value per row and feature, the largest of repeated ones; features out of range are left out."""
    known = triples.where(F.col("feature").between(0, features - 1) & F.col("row_id").isNotNull() & F.col("value").isNotNull())
    return known.groupBy("row_id", "feature").agg(F.max(F.col("value").cast("double")).alias("value"))


def sparse_bins(triples: DataFrame, rows: int, features: int, **limits) -> list[FeatureBins]:
    """Bins of all features, as of a dense table: values that are not stored count as zeros."""
    stored = _whole(triples, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    filled = stored.groupBy("feature").agg(F.sum("n").alias("stored"))
    zeros = filled.where(F.col("stored") < rows).select("feature", F.lit(0.0).alias("value"), (F.lit(rows) - F.col("stored")).alias("n"))
    found = {s.name: s for s in collect_spec(find_numeric_bins(stored.unionByName(zeros).withColumn("feature", F.col("feature").cast("string")), weight="n", **limits))}
    every = []
    for i in range(features):
        s = found.get(str(i)) or FeatureBins(str(i), bounds=[float("inf")])
        every.append(FeatureBins(f"f{i}", bounds=s.bounds, missing_type=s.missing_type, sparse=True))
    return every


def sparse_rows(labels: DataFrame, triples: DataFrame, specs: list[FeatureBins]) -> DataFrame:
    """`labels` (row_id, label, ...) with `bins`, a map of the bins of each row's stored values.

    Bounds join by feature; they are at most features times bins. Stored values of the zero bin are left out.
    """
    spark = labels.sparkSession
    table = [(i, s.bounds, s.default_bin, len(s.bounds) if s.missing_type == "nan" else None) for i, s in enumerate(specs)]
    bounds = spark.createDataFrame(table, "feature int, bounds array<double>, zero int, lost int")
    met = _whole(triples, len(specs)).withColumn("feature", F.col("feature").cast("int")).join(bounds, "feature")
    found = F.least(F.size(F.filter("bounds", lambda b: b < F.col("value"))), F.size("bounds") - 1)
    at = F.when(F.isnan("value"), F.coalesce("lost", "zero")).otherwise(found)
    kept = met.select("row_id", "feature", at.alias("bin"), "zero").where("bin <> zero")
    maps = kept.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "bin"))).alias("bins"))
    return labels.join(maps, "row_id", "left").withColumn("bins", F.coalesce("bins", F.create_map().cast("map<int,int>")))


def sparse_histogram(rows: DataFrame, keys: list[str], zero_bins: DataFrame) -> DataFrame:
    """(keys, feature, bin, g, h, n) of rows whose `bins` are maps; `zero_bins` is (feature, zero).

    Every row also counts under a feature of its own, -1, which gives the totals of a node in
    the same pass. A feature of which no row of a node stores a value has no cut there and no rows here.
    """
    cells = rows.select(*keys, "g", "h", F.explode(F.map_concat("bins", F.create_map(F.lit(-1), F.lit(0)))).alias("feature", "bin"))
    hist = cells.groupBy(*keys, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    totals = hist.where("feature = -1").select(*keys, *[F.col(c).alias(f"t{c}") for c in "ghn"])
    cell = F.struct("bin", "g", "h", "n")
    held = hist.where("feature >= 0").groupBy(*keys, "feature").agg(F.collect_list(cell).alias("cells"), *[F.sum(c).alias(f"s{c}") for c in "ghn"])  # at most the bin limit
    full = held.join(F.broadcast(totals), keys).join(F.broadcast(zero_bins), "feature")  # a row a node; a row a feature
    rest = F.struct(F.col("zero").alias("bin"), *[(F.col(f"t{c}") - F.col(f"s{c}")).alias(c) for c in "ghn"])
    return full.select(*keys, "feature", F.inline(F.concat("cells", F.array(rest)))).where("n > 0")


def train_sparse(labels: DataFrame, triples: DataFrame, features: int, params=None, specs: list[FeatureBins] | None = None):
    """Train on triples; features are called f0, f1, ... Bins come from all rows."""
    from paddock.operators.training import TrainParams, train

    p = params or TrainParams()
    specs = specs or sparse_bins(
        triples, labels.count(), features, max_bin=p.max_bin, min_data_in_bin=p.min_data_in_bin, use_missing=p.use_missing
    )
    return train(sparse_rows(labels, triples, specs), [s.name for s in specs], p, specs=specs)
