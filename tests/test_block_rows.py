"""Rows kept in blocks from round to round train the models of rows joined round by round."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import blocks, state, training, trees
from paddock.operators.blocks import HELD
from paddock.operators.objectives import IN_ARRAYS, MULTI, ObjectiveParams, array_gradients, class_gradients, row_gradients
from paddock.operators.training import TrainParams, _Run, train

FORCED = {"feature": "c", "threshold": 3.0, "left": {"feature": "c", "threshold": 1.0}}

CASES = {
    "bags": dict(objective="binary", bagging_freq=1, bagging_fraction=0.7),
    "forest": dict(objective="binary", boosting="rf", bagging_freq=1, bagging_fraction=0.7),
    "dart": dict(objective="binary", boosting="dart", drop_rate=0.9, skip_drop=0.0),
    "classes": dict(objective="multiclass", objective_params=ObjectiveParams(num_class=3)),
    "medians": dict(objective="regression_l1"),
    "lines": dict(objective="regression", linear_tree=True, linear_lambda=0.1),
    "quantised": dict(objective="binary", use_quantized_grad=True, quant_train_renew_leaf=True),
    "forced": dict(objective="binary", tree=trees.TreeParams(num_leaves=4, min_data_in_leaf=5, forced_splits=FORCED)),
}


def shown(model):
    nodes = [(n.feature, n.bin, n.cat_bins, n.count) for t in model.trees for n in t.nodes]
    leaves = [x for t in model.trees for leaf in t.leaves for x in (leaf.value, leaf.const or 0.0, *sorted((leaf.coeffs or {}).values()))]
    return nodes, leaves


@pytest.mark.parametrize("case", CASES)
def test_blocks_train_as_joined_rows_do(spark, monkeypatch, case):
    """Several blocks, missing values, equal rows, null ids and null labels; no row is joined to another."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(7)
    rows = [
        (None if i % 50 == 3 else i % 400, None if i % 9 == 0 else float(a), float(c), None if i % 70 == 5 else float(c % 3 if case == "classes" else a + c % 3 > 1))
        for i, (a, c) in enumerate(zip(rng.normal(size=500).round(1), rng.integers(0, 9, 500)))
    ]
    df = spark.createDataFrame(rows, "row_id long, a double, c double, label double").repartition(2)
    p = TrainParams(**{"num_iterations": 2, "tree": trees.TreeParams(num_leaves=4, min_data_in_leaf=5), **CASES[case]})
    joined = []
    meet = state.TwoPartRows.meet
    monkeypatch.setattr(state.TwoPartRows, "meet", lambda *a: joined.append(1) or meet(*a))
    nodes, leaves = shown(train(df, ["a", "c"], p).model)
    assert nodes and not joined
    monkeypatch.setattr(_Run, "_rows_alone", lambda self, df: False)
    again, values = shown(train(df, ["a", "c"], p).model)
    assert joined and again == nodes and values == pytest.approx(leaves, abs=1e-9)


def test_init_scores_and_empty_tables(spark):
    df = spark.range(60).selectExpr("id AS row_id", "CAST(id % 6 AS DOUBLE) AS a", "CAST(id % 2 AS DOUBLE) AS label", "IF(id % 3 = 0, NULL, 0.5D) AS init_score")
    p = TrainParams(objective="binary", num_iterations=2, tree=trees.TreeParams(num_leaves=3, min_data_in_leaf=5))
    alone = shown(train(df, ["a"], p).model)
    arrays = df.selectExpr("row_id", "a", "label", "array(coalesce(init_score, 0D)) AS init_score")
    assert shown(train(arrays, ["a"], p).model) == alone and alone[0]
    assert shown(train(df.where("row_id < 0"), ["a"], p).model)[0] == []


@pytest.mark.parametrize("case", ["plain", "classes", "forest", "special", "ranks"])
def test_rows_kept_apart_grow_the_same_trees(spark, monkeypatch, case):
    """levels that ask for few rows read those alone, and no tree changes; null labels, several slots and blocks."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(5)
    rows = [
        (i, i % 40, None if i % 9 == 0 else float(a), float(c), None if i % 70 == 5 and case != "ranks" else float(c % 3 if case in ("classes", "ranks") else a + c % 3 > 1))
        for i, (a, c) in enumerate(zip(rng.exponential(size=700).round(2), rng.integers(0, 9, 700)))
    ]
    df = spark.createDataFrame(rows, "row_id long, group_id long, a double, c double, label double").repartition(2)
    over = {"plain": {}, "special": {}, "ranks": dict(objective="lambdarank")}.get(case, CASES.get(case))
    tree = trees.TreeParams(num_leaves=12, min_data_in_leaf=3, feature_fraction_bynode=0.9 if case == "special" else 1.0)
    p = TrainParams(**{"objective": "binary", "num_iterations": 2, "tree": tree, **over})
    made, apart = [], blocks.apart
    monkeypatch.setattr(blocks, "apart", lambda *a: made.append(1) or apart(*a))
    whole = shown(train(df, ["a", "c"], p).model)
    assert not made and whole[0]
    parts = train(df, ["a", "c"], replace(p, part_rows=0)).model
    assert made and shown(parts) == whole


@pytest.mark.parametrize("objective", IN_ARRAYS)
@pytest.mark.parametrize("weighted", [False, True])
def test_gradients_in_arrays_are_those_of_expressions(spark, objective, weighted):
    """a round's gradients are worked out in the blocks; no row leaves them."""
    op = ObjectiveParams(num_class=3 if objective in MULTI else 1, sigmoid=1.5, scale_pos_weight=2.0, reg_sqrt=True)
    rng = np.random.default_rng(3)
    rows = [(float(y), [float(v) for v in s], float(w)) for y, s, w in zip(rng.integers(0, 3, 50) - (objective == "regression"), rng.normal(size=(50, op.num_class)), rng.integers(0, 4, 50))]
    df = spark.createDataFrame(rows, "label double, scores array<double>, weight double")
    weight = F.col("weight") if weighted else None
    if objective in MULTI:
        pairs = [class_gradients(objective, F.col("label"), F.col("scores"), k, op, weight) for k in range(3)]
    else:
        pairs = [row_gradients(objective, F.col("label"), F.col("scores")[0], op, weight)]
    want = np.array(df.select(*[x.alias(f"x{i}") for i, x in enumerate(x for pair in pairs for x in pair)]).collect()).T
    y, s, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    got = np.stack([x for pair in array_gradients(objective, y, s, op, w if weighted else None) for x in pair])
    assert got == pytest.approx(want, abs=1e-12)
    graded = []
    expressions = training._Run.gradients
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(training._Run, "gradients", lambda self, rows, i: graded.append(HELD in rows.columns) or expressions(self, rows, i))
        table = df.drop("scores").selectExpr("monotonically_increasing_id() AS row_id", "label", "weight AS a", *["weight"] * weighted)
        train(table, ["a"], TrainParams(objective=objective, num_iterations=2, objective_params=op, tree=trees.TreeParams(num_leaves=3, min_data_in_leaf=5)))
    assert graded and not any(graded)
