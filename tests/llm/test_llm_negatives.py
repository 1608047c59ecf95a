"""Hard negatives: Strassen's product, heaps, and whole results against a plain form."""

from __future__ import annotations

import math

import numpy as np
import pytest
from llm_cases import CLASHES
from pyspark.sql import functions as F

from paddock.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 16, 16), (17, 64, 33), (40, 1, 9), (70, 37, 129), (5, 0, 4)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-300, 300, shape[:2]), rng.integers(-300, 300, shape[1:])
    for leaf in (1, 2, 16):
        assert (hn.strassen(a, b, leaf) == a @ b).all() or 0 in shape


def test_strassen_is_exact_where_sums_wrap():
    a = np.full((8, 8), 2**29)
    b = np.full((8, 8), 2**29) * np.where(np.arange(8) % 2, 1, -1)[:, None]
    assert (hn.strassen(a, b, 1) == 0).all()
    assert (hn.strassen(a, np.abs(b), 1) == 8 * 2**58).all()


def test_merged_heaps_keep_the_best():
    one = np.array([[9, 5, hn.NOTHING]]), np.array([[4, 7, 0]])
    two = np.array([[9, 5, 4]]), np.array([[2, 6, 1]])
    scores, ids = hn.merged(one, two, 3)
    assert scores.tolist() == [[9, 9, 5]] and ids.tolist() == [[2, 4, 6]]


def test_shares_round_towards_the_window():
    for p in (-201, -100, -1, 0, 1, 19, 20, 21, 199, 10**18 + 7):
        low, high = int(hn._share_up(np.int64(p), 50)), int(hn._share_down(np.int64(p), 95))
        assert 100 * low >= 50 * p > 100 * (low - 1) and 100 * high <= 95 * p < 100 * (high + 1)


def brute(rows, every=3, positives=5, negatives=3):
    good = []
    for i, lab, v in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if sum(x * x for x in whole) < 2**62:
            good.append((i, lab, whole))
    anchors = {}
    for i, lab, v in sorted(good):
        if i % every == 0:
            anchors.setdefault(i, (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, other, w in good if i != a]
        best = sorted((s, i) for s, i, same in scored if same)[:positives]
        for s, i in best:
            window = sorted((t, j) for t, j, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(window)]
    return sorted(out)


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    return df.withColumns({c: F.lit("x") for c in [*CLASHES, "tile", "lo", "vector", "goals", "v"]})


def rows_of(rng, n, labels, dim=9):
    return [(int(i), int(rng.integers(labels)), [float(np.float32(x)) for x in rng.normal(0.3, 0.4, dim)]) for i in range(n)]


@pytest.mark.parametrize("params", [hn.Params(), hn.Params(tile_rows=7, least_rows=2, leaf=2, held_blocks=1, anchors_per_task=10)])
def test_against_plain_form(spark, params):
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 120, 4)
    rows += [(300, 0, None), (301, None, [0.5] * 9), (None, 1, [0.5] * 9), (302, 1, [0.5, None, 1.0]), (303, 1, [float("nan")] * 9), (306, 2, [float("inf")] + [0.1] * 8)]
    rows += [(309, 1, []), (310, 1, [0.4, 0.3]), (312, 2, [0.3] * 30), (315, 0, [1e30] * 9), (318, -5, [0.2] * 9), (321, 2**31 - 1, [0.2] * 9)]
    rows += [rows[3], rows[3], (6, 1, rows[9][2]), (6, 2, rows[9][2])] + [(400 + k, k % 2, rows[5][2]) for k in range(40)]  # repeats and ties
    got = sorted(tuple(r) for r in hn.mine(table_of(spark, rows), F.col("vec_id") % 3 == 0, params=params).collect())
    assert got == brute(rows) and got


def test_one_label_for_a_third_and_no_negatives(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 7 if i % 3 == 0 else i, v) for i, _, v in rows_of(rng, 90, 1)]
    got = sorted(tuple(r) for r in hn.mine(table_of(spark, rows), F.col("vec_id") % 3 == 0, params=hn.Params(tile_rows=8)).collect())
    assert got == brute(rows)
    alone = [(i, 1, v) for i, _, v in rows]
    assert hn.mine(table_of(spark, alone), F.col("vec_id") % 3 == 0).count() == 0


def test_empty(spark):
    none = table_of(spark, [(1, 1, [1.0])]).limit(0)
    assert hn.mine(none, F.col("vec_id") % 3 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hn.mine(none, F.col("vec_id") % 3 == 0).count() == 0
    assert hn.mine(table_of(spark, [(3, 1, [1.0])]), F.col("vec_id") % 3 == 0).count() == 0
