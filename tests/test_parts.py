"""Training state in two parts, samples, blocks, custom metrics, refitting and streams."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import metrics, sampling, scoring, training
from paddock.operators.binning import FeatureBins
from paddock.operators.contrib import predict_contrib
from paddock.operators.model import Leaf, Model, Node, Tree
from paddock.operators.state import ROW, RoundRows, TwoPartRows
from paddock.operators.trees import TreeParams
from paddock.sources import tables
from paddock.streaming.streams import OnlineRefit


def test_two_parts_meet_without_a_shuffle(spark):
    rows = spark.range(1000).selectExpr("id AS row_id", "array(CAST(id % 7 AS INT), CAST(id % 5 AS INT)) AS bins", "array(CAST(id AS DOUBLE)) AS scores")
    state = TwoPartRows(rows, 2, ["scores"])
    kept = RoundRows(state, state.rows.selectExpr(ROW, "scores", "1L AS qg0"), ["scores", "qg0"], 1)
    for df in (state.rows, kept.rows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    narrow = kept.rows.select(F.col("bins")[1])._jdf.queryExecution().executedPlan().toString()
    assert "b1:smallint" in narrow and "b0:smallint" not in narrow
    state.rewrite(kept.rows.withColumn("scores", F.array(F.col("scores")[0] + 1)))
    got = {r["row_id"]: (r["bins"], r["scores"]) for r in state.rows.collect()}
    assert got == {i: ([i % 7, i % 5], [i + 1.0]) for i in range(1000)}
    before = len(spark.catalog.listTables())
    kept.close()
    state.close()
    assert len(spark.catalog.listTables()) == before - 2


@pytest.mark.parametrize(("n", "k"), [(3000, 100), (3000, 2999), (50, 50), (50, 80), (3000, 0)])
def test_sample_is_the_smallest_keys(spark, n, k):
    df = spark.range(n).selectExpr("id AS row_id", "id * 2 AS other")
    keys = sorted((hashlib.md5(f"{i}/9".encode()).hexdigest()[:16], i) for i in range(n))[:k]
    assert sorted(r["row_id"] for r in sampling.top_by_hash(df.repartition(5), k, 9).collect()) == sorted(i for _, i in keys)


def test_sample_of_repeated_and_missing_ids(spark):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS row_id", "id AS other")
    for k in (1, 299, 300, 301, 599, 600, 700):
        one, two = (sorted(r["other"] for r in sampling.top_by_hash(df.repartition(p), k, 1).collect()) for p in (2, 5))
        assert len(one) == k and one == two


def test_blocks_count_once(spark, tmp_path):
    path = str(tmp_path / "blocks")
    specs = [FeatureBins("a", bounds=[1.0, math.inf])]
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS row_id", "CAST(id % 3 AS DOUBLE) AS a", "1D AS label")
    tables.push_block(rows(0, 10), specs, path, 0)
    tables.push_block(rows(50, 90), specs, path, 2)
    with pytest.raises(ValueError, match="missing"):
        tables.finish_blocks(spark, path, 3)
    tables.push_block(rows(10, 20), specs, path, 1)
    tables.push_block(rows(20, 30), specs, path, 2)  # comes again with other rows
    rows(0, 5).write.parquet(f"{path}/blocks/9")  # a push that failed before its log entry
    tables.finish_blocks(spark, path, 3)
    assert sorted(r["row_id"] for r in tables.load_blocks(spark, path).collect()) == list(range(30))
    with pytest.raises(ValueError, match="finished"):
        tables.push_block(rows(0, 1), specs, path, 3)


def two_class_model():
    def stump(feature, at, values, i, k):
        return Tree([Node(feature, at, left=-1, right=-2)], [Leaf(v) for v in values], i, k)

    return Model([stump("a", 0.5, (0.1, -0.2), 0, 0), stump("b", 0.0, (0.3, 0.2), 0, 1), stump("b", 0.7, (-0.1, 0.4), 1, 0), stump("a", 0.2, (0.2, 0.1), 1, 1)], ["a", "b"], "multiclass", 2)


def table_of(spark, rng, n=200):
    return spark.createDataFrame([(i, float(a), float(b), float(y)) for i, (a, b, y) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 2, n)))], "row_id long, a double, b double, label double")


@pytest.mark.parametrize("every", [1, 10])
def test_refit_follows_the_definition(spark, every):
    df = table_of(spark, np.random.default_rng(2))
    m = two_class_model()
    op = training.ObjectiveParams(num_class=2)
    got = training.refit(df, m, training.TrainParams(objective="multiclass", objective_params=op, checkpoint_every=every), 0.6)
    rows = df.collect()
    scores = np.zeros((len(rows), 2))
    y = np.array([r["label"] for r in rows])
    for i in range(2):
        e = np.exp(scores - scores.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        added = np.zeros_like(scores)
        for at, t in [(at, t) for at, t in enumerate(m.trees) if t.iteration == i]:
            k, n = t.class_id, t.nodes[0]
            leaf = np.array([int(r[n.feature] > n.threshold) for r in rows])
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
            for j in range(2):
                new = 0.6 * t.leaves[j].value + 0.4 * 0.1 * -g[leaf == j].sum() / h[leaf == j].sum()
                assert abs(got.trees[at].leaves[j].value - new) < 1e-9
            added[:, k] += [got.trees[at].leaves[j].value for j in leaf]
        scores += added


def test_walker_and_expressions_agree(spark):
    df = table_of(spark, np.random.default_rng(5)).withColumn("a", F.when(F.col("row_id") % 5 > 0, F.col("a")))
    m = two_class_model()
    for f in (scoring.predict_leaf, scoring.predict_raw):
        assert f(df, m, "x", 0).collect() == f(df, m, "x", 1000).collect()


def test_closed_rows_take_no_more_trees(spark):
    trees = [Tree([Node("a", 0.0, left=-1, right=-2)], [Leaf(-3.0), Leaf(1.0)], i) for i in range(6)]
    df = spark.createDataFrame([(-1.0,), (1.0,), (None,)], "a double")
    got = scoring.predict_early_stop(df, Model(trees, ["a"], "binary"), freq=2, margin=10.0)
    assert [r["raw"] for r in got.collect()] == [-6.0, 6.0, -6.0]


def test_custom_metric_stops_training(spark):
    df = table_of(spark, np.random.default_rng(8))
    worse = metrics.CustomMetric("worse", lambda: F.lit(1.0) + 0 * F.max("prediction"), larger_is_better=True)
    p = training.TrainParams(objective="binary", num_iterations=8, early_stopping_round=1, metric=(worse, "auc"), first_metric_only=True, tree=TreeParams(num_leaves=3))
    got = training.train(df, ["a", "b"], p, valid={"v": df})
    assert len(got.history) == 2 and got.best_iteration == 1 and set(got.history[0]) == {"v:worse", "v:auc"}


def test_online_refit_goes_on_from_the_saved_model(spark, tmp_path):
    df = table_of(spark, np.random.default_rng(9))
    df.write.parquet(str(tmp_path / "in"))
    start = Model([Tree([Node("a", 0.5, left=-1, right=-2)], [Leaf(0.5), Leaf(0.2)])], ["a", "b"], "binary")
    values = []
    for _ in range(2):  # the second start finds no new rows
        online = OnlineRefit(start, training.TrainParams(objective="binary"), 0.5)
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        online.start(stream, str(tmp_path / "progress")).awaitTermination()
        values.append([x.value for x in online.model.trees[0].leaves])
    assert values[0] == values[1] != [0.5, 0.2]


def test_contributions_refuse_linear_leaves(spark):
    linear = Model([Tree([Node("a", 0.5, left=-1, right=-2)], [Leaf(0.5, const=0.1, coeffs={"a": 2.0}), Leaf(0.2)])], ["a"], "regression")
    with pytest.raises(ValueError, match="constant leaves"):
        predict_contrib(spark.createDataFrame([(1.0,)], "a double"), linear, ["a"])
