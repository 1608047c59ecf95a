"""Factors per position: planted bias, penalty, nulls and what a step is."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import position_bias
from paddock.operators.objectives import lambdarank_gradients
from paddock.operators.position_bias import PositionFactors

BIAS = [1.5, 0.75, 0.0, -0.75, -1.5]


@pytest.fixture(scope="module")
def clicks(spark):
    """Groups of five rows shown in random order: clicks follow the score and the place."""
    rng = random.Random(11)
    rows = []
    for group in range(400):
        for place in range(5):
            score = rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
            clicked = rng.random() < 1 / (1 + math.exp(-(score + BIAS[place])))
            rows.append((len(rows), group, float(clicked), score, place))
        rows.append((len(rows), group, 0.0, -3.0, None))
    return spark.createDataFrame(rows, "row_id long, group_id int, label double, score double, position int").cache()


def _steps(rows, count, pull=0.0):
    factors = PositionFactors.zeros(rows)
    for _ in range(count):
        factors = factors.stepped(lambdarank_gradients(factors.added_to(rows)), 0.5, pull)
    return {r["position"]: r["factor"] for r in factors.table.collect()}


def test_planted_bias_is_found_and_penalty_shrinks_it(clicks):
    free = _steps(clicks, 3)
    assert sorted(free) == [0, 1, 2, 3, 4]
    ordered = [free[p] for p in range(5)]
    assert ordered == sorted(ordered, reverse=True) and ordered[0] - ordered[4] > 1.0
    held = _steps(clicks, 3, pull=1.0)
    assert max(map(abs, held.values())) < max(map(abs, free.values())) / 2


def test_a_step_by_hand(spark):
    graded = spark.createDataFrame(
        [(1, 0.5, 0.25), (1, 1.0, 0.5), (2, -1.0, 0.0), (None, 9.0, 9.0), (1, None, None)], "position int, g double, h double"
    )
    start = PositionFactors(spark.createDataFrame([(1, 0.5), (2, -0.5), (3, 0.75)], "position int, factor double"))
    got = {r["position"]: r["factor"] for r in start.stepped(graded, 0.1, 0.25).table.collect()}
    assert got[1] == pytest.approx(0.5 - 0.1 * (1.5 + 0.25 * 2 * 0.5) / (0.75 + 0.5 + 1e-3))
    assert got[2] == pytest.approx(-0.5 - 0.1 * (-1.0 - 0.125) / (0.25 + 1e-3))
    assert got[3] == 0.75


@pytest.mark.parametrize("limit", [100_000, 0])
def test_scores_keep_their_rows_and_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(position_bias, "BROADCAST_POSITIONS", limit)
    rows = spark.createDataFrame([(1, 7, 1.0, "a"), (1, 7, 1.0, "a"), (2, None, 2.0, "b"), (3, 9, 3.0, "c")], "row_id int, position int, score double, factor string")
    raised = PositionFactors(spark.createDataFrame([(7, 0.5)], "position int, factor double")).added_to(rows)
    assert raised.columns == rows.columns
    assert sorted(map(tuple, raised.collect())) == [(1, 7, 1.5, "a"), (1, 7, 1.5, "a"), (2, None, 2.0, "b"), (3, 9, 3.0, "c")]


def test_no_rows(spark):
    none = spark.createDataFrame([], "row_id int, position int, score double, g double, h double")
    zero = PositionFactors.zeros(none)
    assert zero.stepped(none, 0.1).table.count() == 0
    assert zero.added_to(none.withColumn("x", F.lit(1))).count() == 0
