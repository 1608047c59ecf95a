"""Ranking gradients in arrays: every pair by itself, groups in many slices, missing values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import objectives
from paddock.operators.objectives import ObjectiveParams, lambdarank_gradients


def by_pairs(rows, p):
    """Every pair of every group, as the formulas say; None where a pair that counts lacks a score."""
    out, groups = {}, {}
    for row_id, group, y, s in rows:
        groups.setdefault(group, []).append((row_id, y, s))
    for group, members in groups.items():
        if group is None:
            continue
        members.sort(key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
        ideal = sorted((y for _, y, _ in members if y is not None), reverse=True)[: p.truncation_level]
        best = sum((2.0**y - 1) / math.log2(2 + i) for i, y in enumerate(ideal))
        scores = [s for *_, s in members if s is not None]
        flat = not scores or max(scores) == min(scores)
        g, h, own = [0.0] * len(members), [0.0] * len(members), [True] * len(members)
        sizes = [0.0] * len(members)
        for j, (_, y, s) in enumerate(members):
            for i in range(min(j, p.truncation_level)):
                _, other, fs = members[i]
                if y is None or other is None or y == other or best <= 0:
                    continue
                if s is None or fs is None:
                    own[j] = False
                    continue
                ahead = s - fs if y > other else fs - s
                rho = 1 / (1 + math.exp(p.sigmoid * ahead))
                delta = abs(2.0**y - 2.0**other) * abs(1 / math.log2(2 + j) - 1 / math.log2(2 + i)) / best
                if p.lambdarank_norm and not flat:
                    delta /= 0.01 + abs(s - fs)
                force, curve = p.sigmoid * delta * rho, p.sigmoid**2 * delta * rho * (1 - rho)
                side = -1 if y > other else 1
                g[j], g[i] = g[j] + side * force, g[i] - side * force
                h[j], h[i] = h[j] + curve, h[i] + curve
                sizes[j] += force
        both = 2 * sum(x for x, known in zip(sizes, own) if known)
        scale = math.log2(1 + both) / both if p.lambdarank_norm and both > 0 else 1.0
        for (row_id, *_), a, b, known in zip(members, g, h, own):
            out[row_id] = (a * scale, b * scale) if known else (None, None)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == (None, None) if pair == (None, None) else got[k] == pytest.approx(pair, abs=1e-9), k


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("norm", [False, True])
def test_gradients_are_those_of_all_pairs(spark, holes, norm):
    """groups of one row, of equal scores or labels, and one that goes over all slices."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        group = 7 if i % 2 else i % 37
        hole = lambda x, every: None if holes and i % every == 3 else x
        rows.append((i, hole(group, 31), hole(float(rng.randint(0, 3)), 17), hole(1.0 if group == 4 else rng.randint(-6, 6) / 4.0, 23)))
    rows += [(1000, 100, 1.0, 0.5), (1001, 101, 0.0, 0.5), (1002, 101, 0.0, 0.7), (1003, 102, None, None)]
    p = ObjectiveParams(truncation_level=5, sigmoid=1.5, lambdarank_norm=norm)
    df = spark.createDataFrame(rows, "row_id long, group_id long, label double, score double").repartition(5)
    want = by_pairs(rows, p)
    out = lambdarank_gradients(df, p)
    assert out.columns == ["row_id", "group_id", "label", "score", "g", "h"]
    same({r["row_id"]: (r["g"], r["h"]) for r in out.collect()}, want)
    named = df.withColumn("group_id", F.concat(F.lit("g"), "group_id"))
    same({r["row_id"]: (r["g"], r["h"]) for r in lambdarank_gradients(named, p).collect()}, want)


def test_no_row_carries_its_groups_first_rows(spark):
    """Rows leave for Python as they are, beside nothing of their group; small chunks change nothing."""
    rows = [(i, i % 3, float(i % 4), i % 7 / 2.0) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, label double, score double")
    out = lambdarank_gradients(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "firsts" not in plan and "Aggregate" not in plan
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(objectives, "pair_gradients", lambda *a: _small_chunks(a))
        small = lambdarank_gradients(df)
        same({r["row_id"]: (r["g"], r["h"]) for r in small.collect()}, {r["row_id"]: (r["g"], r["h"]) for r in out.collect()})


def _small_chunks(args):
    from paddock.operators import ranking

    sliced, row_id, settings = args
    graded = ranking._graded(ranking._spread_groups(sliced, settings), settings, row_id)

    def run(batches):
        from paddock.operators import ranking as there

        there.CHUNK_ROWS = 16
        try:
            yield from graded(batches)
        finally:
            there.CHUNK_ROWS = 1 << 16

    return sliced.mapInArrow(run, "row_id long, g double, h double")
