"""Sparse training: the same trees as from dense rows, and many features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paddock.operators import sparse, training
from paddock.operators.trees import TreeParams


def shape(model):
    return [([(n.feature, n.bin, round(n.threshold, 9), round(n.gain, 6), n.count) for n in t.nodes], [(round(x.value, 9), x.count) for x in t.leaves]) for t in model.trees]


def test_same_trees_as_dense_rows(spark):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((400, 5)) < 0.3, np.round(rng.normal(size=(400, 5)), 2), 0.0)
    y = ((dense[:, 0] > 0) ^ (dense[:, 3] < 0)).astype(float)
    wide = spark.createDataFrame([(i, float(y[i]), *map(float, dense[i])) for i in range(400)], "row_id long, label double, " + ", ".join(f"f{j} double" for j in range(5)))
    stored = [(i, j, float(dense[i, j])) for i in range(400) for j in range(5) if dense[i, j] != 0 or (i + j) % 11 == 0]  # some zeros are stored
    triples = spark.createDataFrame([*stored, (3, 99, 1.0), (3, -1, 1.0), (None, 0, 1.0), (4, 0, None)], "row_id long, feature int, value double")
    p = training.TrainParams(objective="binary", num_iterations=3, bin_construct_sample_cnt=None, max_bin=30, tree=TreeParams(num_leaves=6, min_data_in_leaf=5))
    one = training.train(wide, [f"f{j}" for j in range(5)], p)
    two = sparse.train_sparse(wide.select("row_id", "label"), triples, 5, p)
    assert [s.bounds for s in one.specs] == [s.bounds for s in two.specs]
    assert shape(one.model) == shape(two.model)


def test_twenty_thousand_features(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(f), float(rng.normal())) for i in range(500) for f in rng.integers(0, 20_000, 6)] + [(i, 12_345, 2.0) for i in range(0, 500, 3)]
    triples = spark.createDataFrame(rows, "row_id long, feature int, value double")
    labels = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    p = training.TrainParams(objective="binary", num_iterations=1, tree=TreeParams(num_leaves=3))
    got = sparse.train_sparse(labels, triples, 20_000, p).model
    root = got.trees[0].nodes[0]
    assert root.feature == "f12345" and root.count == 500
    assert sorted(x.count for x in got.trees[0].leaves) == [167, 333]
