"""Rows packed in blocks give the sums that rows by themselves give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import blocks, trees
from paddock.operators.binning import FeatureBins
from paddock.operators.state import ROW, RoundRows, TwoPartRows
from paddock.operators.training import TrainParams, train

SPECS = [FeatureBins("a", bounds=[0.0, 1.0, float("inf")], missing_type="nan"), FeatureBins("b", kind="categorical", categories=[5, 6, 7, 8])]


def state_of(spark, rows=3000):
    df = spark.range(rows).selectExpr("id AS row_id", "array(CAST(id * 7 % 4 AS INT), CAST(id * 11 % 5 AS INT)) AS bins", "array(0D) AS scores")
    return TwoPartRows(df, 2, ["scores"])


def sums_by_rows(state, narrow, slot, node):
    rows = state.meet(narrow).where(f"qg{slot} IS NOT NULL").select(node.alias("node"), F.col(f"qg{slot}").alias("g"), F.col(f"qh{slot}").alias("h"), "bins")
    return sorted((slot, *r) for r in trees.gradient_histogram(rows.where("node IS NOT NULL"), ["node"]).collect())


def test_blocks_sum_as_rows_do(spark, monkeypatch):
    """Nulls, huge gradients, several slots, blocks that end in a partition, and both kinds of split."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    state = state_of(spark)
    big = 1 << 58
    graded = state.rows.selectExpr(
        ROW, "scores", f"IF(row_id % 3 = 0, NULL, {big} + row_id) AS qg0", "IF(row_id % 5 = 0, NULL, row_id) AS qh0",
        "IF(row_id % 2 = 0, NULL, -row_id) AS qg1", "3L AS qh1",
    )
    slots = [("qg0", "qh0"), ("qg1", "qh1")]
    few = graded.where("row_id < 16")  # so that the sums of huge gradients stay within a bigint
    for narrow in (few, graded.withColumn("qg0", F.col("qg0") - big)):
        kept = RoundRows(state, narrow, ["scores", "qg0", "qh0", "qg1", "qh1"], 2, packed=slots)
        way = blocks.Step(0, 1, 3, True, None, blocks.Step(1, 0, -1, False, (1, 3), 0, 1), None)
        asked = [blocks.Asked(0, way, (4, 9)), blocks.Asked(1, 0, (0,))]
        got = sorted(tuple(r) for r in blocks.histograms(kept.blocks, 2, SPECS, False, asked, [0, 1]).collect())
        left = (F.col("bins")[0] <= 1) | (F.col("bins")[0] == 3)
        node = F.when(left, F.when(F.col("bins")[1].isin(1, 3), 4).otherwise(9))
        want = sums_by_rows(state, kept.narrow, 0, node) + sums_by_rows(state, kept.narrow, 1, F.lit(0))
        assert got == sorted((s, n, f, b, g, h or 0, c) for s, n, f, b, g, h, c in want)
        kept.close()
    state.close()


def test_levels_read_blocks_only(spark, monkeypatch):
    """Training sums dense rows in blocks, and gives the trees of rows summed one by one."""
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(c), float(a + c % 3 > 1)) for i, (a, c) in enumerate(zip(rng.normal(size=600), rng.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "row_id long, a double, c double, label double")
    p = TrainParams(objective="binary", num_iterations=2, tree=trees.TreeParams(num_leaves=6, min_data_in_leaf=5, min_data_per_group=5))
    shown = lambda m: [(n.feature, n.bin, n.cat_bins, n.gain, n.count) for t in m.trees for n in t.nodes]
    seen = []
    row_by_row = trees._row_histogram
    monkeypatch.setattr(trees, "_row_histogram", lambda *a: seen.append(1) or row_by_row(*a))
    packed = shown(train(df, ["a", "c"], p, ["c"]).model)
    assert packed and not seen
    monkeypatch.setattr(trees, "TASK_SUMS", 0)  # too many sums for a task: Spark's own aggregate takes them
    assert shown(train(df, ["a", "c"], p, ["c"]).model) == packed and seen


@pytest.mark.parametrize("missing_bin, side", [(2, [True, False, True, False]), (-1, [True, False, False, False])])
def test_sides(missing_bin, side):
    step = blocks.Step(0, 0, missing_bin, True, None, 0, 1)
    assert blocks._side(step, np.array([0, 1, 2, 3])).tolist() == side
