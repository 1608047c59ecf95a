"""Learning half: golden smoke run, growth against brute force, contributions, metrics, options."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import binning as B
from paddock.operators import metrics, model, objectives, sampling, scoring, training, trees
from paddock.operators.contrib import contributions
from paddock.plans.train_or_load import train_or_load


@pytest.fixture(scope="module")
def smoke_rows(spark):
    return spark.range(16).select(
        F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (F.col("id") >= 8).cast("double").alias("label")
    )


SMOKE = training.TrainParams(
    objective="binary", num_iterations=25, learning_rate=0.3, max_bin=16, min_data_in_bin=1,
    tree=trees.TreeParams(num_leaves=4, min_data_in_leaf=1),
)


def test_golden_smoke_run_and_reload(spark, smoke_rows, tmp_path):
    probe = smoke_rows.where("x in (1.0, 14.0)")
    first = train_or_load(smoke_rows, ["x"], SMOKE, str(tmp_path), probe).first()
    again = train_or_load(smoke_rows, ["x"], SMOKE, str(tmp_path), probe).first()
    assert (first["mode"], again["mode"], first["iterations"]) == ("trained", "loaded", 25)
    for row in (first, again):
        assert row["separated"]
        assert row["low"] == pytest.approx(0.00024643, abs=1e-8)
        assert row["high"] == pytest.approx(0.99975357, abs=1e-8)


def brute_tree(x, y, leaves, min_data):
    """One-leaf-at-a-time best-first growth for squared loss, by trying every cut."""

    def best(rows):
        found = None
        g = -y[rows]
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= cut
                n = left.sum()
                if n < min_data or len(rows) - n < min_data:
                    continue
                gain = g[left].sum() ** 2 / n + g[~left].sum() ** 2 / (len(rows) - n) - g.sum() ** 2 / len(rows)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, cut)
        return found

    parts = [np.arange(len(y))]
    splits = [best(parts[0])]
    order = []
    while len(parts) < leaves and any(splits):
        i = max((i for i, s in enumerate(splits) if s), key=lambda i: splits[i][0])
        _, f, cut = splits[i]
        order.append((f, round(splits[i][0], 4)))
        rows = parts[i]
        parts[i] = rows[x[rows, f] <= cut]
        parts.append(rows[x[rows, f] > cut])
        splits[i] = best(parts[i])
        splits.append(best(parts[-1]))
    return order, sorted(round(float(y[p].mean()), 6) for p in parts)


def test_frontier_growth_equals_one_leaf_growth(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = np.round(x[:, 0] * 2 + (x[:, 1] > 5) * 7 + rng.normal(0, 2, 300), 3)
    y = y - y.mean()
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, label double")
    p = training.TrainParams(
        num_iterations=1, learning_rate=1.0, boost_from_average=False, min_data_in_bin=1,
        tree=trees.TreeParams(num_leaves=7, min_data_in_leaf=10),
    )
    tree = training.train(df, ["a", "b", "c"], p).model.trees[0]
    order, means = brute_tree(x, y, 7, 10)
    assert [("abc".index(n.feature), round(n.gain, 4)) for n in tree.nodes] == order
    assert sorted(round(v.value, 6) for v in tree.leaves) == pytest.approx(means, abs=2e-6)
    assert sum(v.count for v in tree.leaves) == 300
    again = training.train(df.repartition(5), ["a", "b", "c"], replace(p, subtract_rows=0)).model.trees[0]
    assert again == tree  # other partitions, larger children derived from their parents


def shapley(tree, row, at):
    """Contributions from the definition: all coalitions, missing features averaged by cover."""

    def value(known, child=0 if tree.nodes else -1):
        if child < 0:
            return tree.leaves[-1 - child].value
        n = tree.nodes[child]
        count = lambda c: tree.leaves[-1 - c].count if c < 0 else tree.nodes[c].count
        if at[n.feature] in known:
            return value(known, n.left if row[at[n.feature]] <= n.threshold else n.right)
        return (value(known, n.left) * count(n.left) + value(known, n.right) * count(n.right)) / n.count

    d = len(at)
    out = []
    for i in range(d):
        total = 0.0
        for k in range(d):
            for rest in itertools.combinations([j for j in range(d) if j != i], k):
                w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                total += w * (value({*rest, i}) - value(set(rest)))
        out.append(total)
    return [*out, value(set())]


def test_contributions_match_the_definition(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (200, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + x[:, 2]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, label double")
    p = training.TrainParams(num_iterations=1, min_data_in_bin=1, tree=trees.TreeParams(num_leaves=8, min_data_in_leaf=5))
    tree = training.train(df, ["a", "b", "c"], p).model.trees[0]
    got = contributions(tree, x[:12], {"a": 0, "b": 1, "c": 2})
    for i in range(12):
        assert got[i] == pytest.approx(shapley(tree, x[i], {"a": 0, "b": 1, "c": 2}), abs=1e-9)


def test_expression_and_walker_agree_on_missing_and_categories(spark):
    from paddock.plans.tree_queries import FIXED_MODEL

    values = [None, float("nan"), 0.0, -0.5, 0.03, 25.0, 26.0, 3.0, 5.7, -2.0]
    rows = [(i, *combo) for i, combo in enumerate(itertools.product(values, values[:6], values[:5], values))]
    df = spark.createDataFrame(rows, "row_id long, l_quantity double, l_discount double, l_tax double, l_linenumber double")
    a = scoring.predict_raw(df, FIXED_MODEL)
    b = scoring.predict_raw(a, FIXED_MODEL, "walked", expression_nodes=0)
    assert b.where("raw <> walked").count() == 0


def test_small_bins_join_neighbours(spark):
    values = [0.0] * 5 + [1.0] + [2.0] * 2 + [3.0] * 4 + [-1.0] * 3 + [float("nan")] * 2
    df = spark.createDataFrame([("f", v) for v in values], "feature string, value double")
    got = B.collect_spec(B.find_numeric_bins(df, min_data_in_bin=3))[0]
    assert got.missing_type == "nan" and got.num_bins == 5
    assert got.bounds[0] == -1e-35 and got.bounds[1] == 1e-35 and got.bounds[-1] == float("inf")
    assert got.bounds[2] == np.nextafter(2.5, np.inf)
    binned = df.select("value", B.value_to_bin(F.col("value"), got).alias("b")).distinct().collect()
    assert {r["b"] for r in binned} == {0, 1, 2, 3, 4}


def test_lambdarank_truncation_counts_each_pair_once(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, float(rng.randint(0, 3)), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, group_id int, label double, score double")
    p = objectives.ObjectiveParams(truncation_level=4, lambdarank_norm=False)
    got = {r["row_id"]: (r["g"], r["h"]) for r in objectives.lambdarank_gradients(df, p).collect()}
    want = {i: [0.0, 0.0] for i, *_ in rows}
    for g in range(3):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[0]))
        gains = sorted((2 ** r[2] - 1 for r in own), reverse=True)
        best = sum(v / math.log2(2 + k) for k, v in enumerate(gains[:4]))
        for (i, a), (j, b) in itertools.combinations(enumerate(own), 2):
            if i >= 4 or a[2] == b[2]:
                continue
            hi, lo = (a, b) if a[2] > b[2] else (b, a)
            delta = abs(2 ** a[2] - 2 ** b[2]) * abs(1 / math.log2(2 + i) - 1 / math.log2(2 + j)) / best
            rho = 1 / (1 + math.exp(hi[3] - lo[3]))
            want[hi[0]][0] -= delta * rho
            want[lo[0]][0] += delta * rho
            for r in (hi, lo):
                want[r[0]][1] += delta * rho * (1 - rho)
    for i in want:
        assert got[i] == pytest.approx(tuple(want[i]), abs=1e-9)


def test_ranking_metrics_limit_hot_groups_before_the_shuffle(spark):
    df = spark.range(500).select(
        (F.col("id") % 10 == 0).cast("int").alias("group_id"), F.col("id").alias("row_id"), (F.col("id") % 4).cast("double").alias("label"), F.rand(1).alias("score")
    )
    plan = metrics.ndcg(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_options_shape_the_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 10, (400, 3)).astype(float)
    y = -x[:, 0] + 3 * (x[:, 1] > 4) + rng.normal(0, 0.5, 400)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, label double")
    specs = training.prepare_bins(df, ["a", "b", "c"], [], training.TrainParams())
    base = training.TrainParams(num_iterations=1, tree=trees.TreeParams(num_leaves=5, min_data_in_leaf=5))

    def grown(**tree):
        return training.train(df, ["a", "b", "c"], replace(base, tree=replace(base.tree, **tree)), specs=specs).model.trees[0]

    assert {n.feature for n in grown().nodes} >= {"a", "b"}
    assert "a" not in {n.feature for n in grown(monotone_constraints={"a": 1}).nodes}
    assert len({n.feature for n in grown(interaction_constraints=(("a",), ("b",))).nodes}) == 1
    forced = grown(forced_splits={"feature": "c", "threshold": 4.0, "right": {"feature": "b", "threshold": 4.0}})
    assert [n.feature for n in forced.nodes[:2]] == ["c", "b"]
    assert "b" not in {n.feature for n in grown(cegb_penalty_feature_coupled={"b": 1e6}).nodes}
    assert "a" not in {n.feature for n in grown(feature_contri={"a": 0.0}).nodes}
    assert max(leaf.depth for leaf in grown(max_depth=2).leaves) == 2
    smooth = grown(path_smooth=50.0)
    assert max(abs(leaf.value) for leaf in smooth.leaves) < max(abs(leaf.value) for leaf in grown().leaves)


def test_linear_leaves_fit_a_line(spark):
    from paddock.operators.leaves import linear_leaves
    from paddock.operators.model import Leaf, Model, Node, Tree

    a = (F.col("id") % 50).cast("double")
    y = F.when(a <= 24, 2.0 * a + 1.0).otherwise(5.0 - a)
    df = spark.range(200).select(a.alias("a"), y.alias("label"), (-y).alias("g"), F.lit(1.0).alias("h"))
    tree = Tree([Node("a", 24.0, left=-1, right=-2)], [Leaf(25.0, 100, 100), Leaf(-32.0, 100, 100)])
    linear_leaves(df, tree, F.expr(scoring.leaf_sql(tree)), 0.0)
    assert tree.leaves[0].const == pytest.approx(1.0) and tree.leaves[0].coeffs["a"] == pytest.approx(2.0)
    assert tree.leaves[1].const == pytest.approx(5.0) and tree.leaves[1].coeffs["a"] == pytest.approx(-1.0)
    scored = scoring.predict_raw(df, Model([tree], ["a"]))
    assert scored.agg(F.max(F.abs(F.col("raw") - F.col("label")))).first()[0] < 1e-6
    lost = scoring.predict_raw(spark.createDataFrame([(float("nan"),)], "a double"), Model([tree], ["a"]))
    assert lost.first()["raw"] == 25.0  # NaN counts as 0 on the way down and takes the plain value in the leaf


def test_early_stopping_rule():
    p = training.TrainParams(early_stopping_round=2, metric=("l2", "auc"), first_metric_only=True)
    rule = training.EarlyStopping(p)
    values = [3.0, 2.0, 2.5, 2.2]
    stops = [rule.update(i, {"v:l2": v, "v:auc": 0.1}) for i, v in enumerate(values)]
    assert stops == [False, False, False, True] and rule.best_iteration == 2


def test_merge_slice_round_trip(spark):
    from paddock.plans.tree_queries import FIXED_MODEL

    nodes, leaves, meta = model.to_tables(spark, FIXED_MODEL)
    both = model.merge_models(leaves, leaves)
    assert both.agg(F.count_distinct("tree_id")).first()[0] == 6
    assert model.slice_model(both, 3).count() == leaves.count()
    assert model.from_tables(nodes, leaves, meta) == FIXED_MODEL
    assert model.rollback_one(FIXED_MODEL).iterations == 2


def test_samples_are_repeatable_and_sized(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id").withColumn("label", (F.col("row_id") % 2).cast("double"))
    a, b = (sampling.sample_for_bins(df.repartition(n), 700) for n in (2, 5))
    assert a.count() == 700 and a.exceptAll(b).count() == 0
    share = sampling.balanced_bagging(df, 0, 0.9, 0.1, 1).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in share}
    assert counts[1.0] > 2100 and counts[0.0] < 400
    assert sampling.bagging(df, 0, 0.5, 2).exceptAll(sampling.bagging(df, 1, 0.5, 2)).count() == 0


def test_training_table_reader(spark, tmp_path):
    from paddock.sources.tables import read_training_table

    path = tmp_path / "train.csv"
    path.write_text("y,w,a,b,q\n1,0.5,na,2,7\n0,1,3.5,-1e2,7\n0,1,oops,1,8\n")
    rows, rejects, names = read_training_table(spark, str(path), header=True, label="name:y", weight="name:w", group="name:q")
    assert names == ["a", "b"] and rows.columns == ["label", "weight", "group_id", "a", "b"]
    got = sorted(rows.collect(), key=lambda r: r["label"])
    assert (got[0]["a"], got[0]["b"], got[0]["weight"]) == (3.5, -100.0, 1.0) and math.isnan(got[1]["a"])
    assert [r["a"] for r in rejects.collect()] == ["oops"]
    plain, _, names = read_training_table(spark, str(tmp_path / "train.csv"), header=True, label=0, weight=0, ignore=[3])
    assert plain.columns == ["label", "weight", "a", "b"] and names == ["a", "b"]


def test_stream_archives_maps_new_months(spark, tmp_path):
    from test_race import HORSES, PAYBACK, RACES, bundle_bytes

    from paddock.streaming.streams import stream_archives

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    names = ("racelist", "horselist", "payback")
    (inbox / "199808_race.zip").write_bytes(bundle_bytes({f"199808_{n}.csv": t for n, t in zip(names, (RACES, HORSES, PAYBACK))}))
    seen = []
    stream_archives(spark, str(inbox), str(tmp_path / "progress"), lambda m, i: seen.append(m.entries.count())).awaitTermination()
    assert seen == [14]


def test_races_to_model_uses_only_pre_race_columns(spark):
    from paddock.plans.derived import derived_month
    from paddock.plans.train_or_load import race_features

    df, features = race_features(derived_month(spark, "/root/testdata/sf0.001"))
    assert not {"finish_position", "payouts"} & set(df.columns)
    assert set(features) <= set(df.columns) and df.count() > 5000
