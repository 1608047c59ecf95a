"""Laws: what seeded, weighted or stored results must satisfy, one row each, with SQL twins.

Rows of a seeded sample cannot be said in SQL; what must hold for any of them can.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions.numeric import to_places
from paddock.operators import metrics, model, objectives, sampling, scoring
from paddock.operators.binning import SPEC_SCHEMA, bin_table
from paddock.operators.contrib import predict_contrib, predict_sparse
from paddock.operators.training import TrainParams, train
from paddock.operators.trees import TreeParams
from paddock.plans.catalog import query, sql6, table
from paddock.plans.learning_queries import _CLASS_SUM, _EVENTS_SQL, _SCORED_SQL, LINES_SQL, _class_sums, _scored, events, lines
from paddock.plans.tree_queries import (
    _FEATURES, _HOLE_SQL, _PACKED_SQL, _PLAIN, _RAW_SQL, _ROW, _SPECS, FIXED_MODEL, _as_text, _plain, _scratch, holed, train_rows,
)
from paddock.sources import tables

# --- weights ---


@query(
    "boost_from_average_weighted",
    f"""WITH r AS (SELECT y_reg AS y, w / greatest(1e0, abs(y_reg)) AS mw, w FROM {LINES_SQL}),
      q AS (SELECT y, sum(w) OVER (ORDER BY y) AS u, sum(mw) OVER (ORDER BY y) AS mu, sum(w) OVER () AS t, sum(mw) OVER () AS mt FROM r)
    SELECT 'mean' AS kind, {sql6("sum(w * y_reg) / sum(w)")} AS start FROM {LINES_SQL}
    UNION ALL SELECT 'binary', {sql6("ln(sum(w * y_bin) / sum(w * (1e0 - y_bin)))")} FROM {LINES_SQL}
    UNION ALL SELECT 'quantile', {sql6("min(y)")} FROM q WHERE u >= t * (9e-1 - 1e-12)
    UNION ALL SELECT 'mape', {sql6("min(y)")} FROM q WHERE mu >= mt * (5e-1 - 1e-12)""",
)
def _weighted_starts(spark, sf):
    df, out = lines(spark, sf), None
    for kind, objective, label in (("mean", "regression", "y_reg"), ("binary", "binary", "y_bin"), ("quantile", "quantile", "y_reg"), ("mape", "mape", "y_reg")):
        start = objectives.start_score(df, objective, label=label, weight="weight")
        row = start.select(F.lit(kind).alias("kind"), to_places(F.col("start")).alias("start"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "eval_all_weighted",
    f"""SELECT 'train' AS dataset, 'l2' AS metric, {sql6("sum(w * (p - y) * (p - y)) / sum(w)")} AS value FROM {_SCORED_SQL}
        UNION ALL SELECT 'train', 'rmse', {sql6("sqrt(sum(w * (p - y) * (p - y)) / sum(w))")} FROM {_SCORED_SQL}
        UNION ALL SELECT 'train', 'quantile', {sql6("sum(w * CASE WHEN y < p THEN (2e-1 - 1e0) * (y - p) ELSE 2e-1 * (y - p) END) / sum(w)")} FROM {_SCORED_SQL}""",
)
def _eval_all_weighted(spark, sf):
    out = metrics.eval_all({"train": _scored(spark, sf)}, ["l2", "rmse", "quantile"], {"quantile": {"alpha": 0.2}}, weight="weight")
    return out.select("dataset", "metric", to_places(F.col("value")).alias("value"))


@query(
    "metric_map_weighted",
    f"""SELECT 'map@5' AS metric, {sql6("sum(gw * CASE WHEN rel > 0 THEN prec / least(rel, 5) ELSE 1e0 END) / sum(gw)")} AS value FROM
        (SELECT group_id, avg(weight) AS gw, sum(hit) AS rel, sum(CASE WHEN rk <= 5 AND hit = 1 THEN hits * 1e0 / rk ELSE 0e0 END) AS prec FROM
         (SELECT *, sum(hit) OVER (PARTITION BY group_id ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM
          (SELECT *, CASE WHEN label > 0 THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, row_id) AS rk FROM {_EVENTS_SQL}))
         GROUP BY group_id)""",
)
def _map_weighted(spark, sf):
    out = metrics.evaluate(events(spark, sf), "map@5", weight="weight")
    return out.select("metric", to_places(F.col("value")).alias("value"))


@query(
    "metric_auc_mu_weighted",
    f"""WITH c AS (SELECT label, 1e0 + vec_id % 3 AS w, {_CLASS_SUM} AS e FROM embeddings),
             s AS (SELECT a.i, b.j, w, CASE WHEN label = a.i THEN 1e0 ELSE 0e0 END AS pos, e[a.i + 1] - e[b.j + 1] AS v
                   FROM c, range(0, 10) a(i), range(0, 10) b(j) WHERE a.i < b.j AND label IN (a.i, b.j)),
             u AS (SELECT x.i, x.j, sum(x.w * y.w * CASE WHEN x.v > y.v THEN 1e0 WHEN x.v = y.v THEN 5e-1 ELSE 0e0 END) / sum(x.w * y.w) AS area
                   FROM s x JOIN s y ON x.i = y.i AND x.j = y.j AND x.pos = 1 AND y.pos = 0 GROUP BY x.i, x.j)
        SELECT 'auc_mu' AS metric, {sql6('sum(area) / 45')} AS value FROM u""",
)
def _auc_mu_weighted(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (1.0 + F.col("vec_id") % 3).alias("w"), _class_sums().alias("scores"))
    return metrics.auc_mu(e, 10, weight="w").select("metric", to_places(F.col("value")).alias("value"))


@query(
    "evaluation_follows_weights",
    """SELECT 1 AS rounds, CAST(0 AS BIGINT) AS apart""",
)
def _evaluation(spark, sf):
    """A run's own history equals the metric recomputed from its model, with weights and alpha."""
    df = train_rows(spark, sf).withColumn("label", F.col("y_reg")).withColumn("weight", 1.0 + F.pmod("row_id", F.lit(3)))
    op = objectives.ObjectiveParams(alpha=0.2)
    p = TrainParams(objective="quantile", num_iterations=1, bin_construct_sample_cnt=None, tree=TreeParams(num_leaves=3), objective_params=op)
    got = train(df, _FEATURES, p, valid={"all": df})
    loss = F.when(F.col("label") < F.col("raw"), -0.8 * (F.col("label") - F.col("raw"))).otherwise(0.2 * (F.col("label") - F.col("raw")))
    own = scoring.predict_raw(df, got.model).agg(F.sum(F.col("weight") * loss) / F.sum("weight")).first()[0]
    apart = int(abs(got.history[0]["all:quantile"] - own) > 1e-9)
    return spark.createDataFrame([(len(got.history), apart)], "rounds int, apart long")


# --- seeded samples ---


def _near(share: float, wanted: float, slack: float) -> bool:
    return abs(share - wanted) <= slack


@query("bagging_laws", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS changed, true AS near, true AS renewed FROM events")
def _bagging_laws(spark, sf):
    """A bag lies inside the table, lasts `freq` rounds, holds about its share, then changes."""
    e = events(spark, sf)
    bag, same, other = (sampling.bagging(e, i, 0.5, 2).select("row_id") for i in (4, 5, 6))
    rows, kept = e.count(), bag.count()
    changed = bag.exceptAll(same).count() + same.exceptAll(bag).count()
    row = (rows, bag.join(e, "row_id", "left_anti").count(), changed, _near(kept / rows, 0.5, 0.05), not bag.exceptAll(other).isEmpty())
    return spark.createDataFrame([row], "rows long, outside long, changed long, near boolean, renewed boolean")


@query("balanced_bagging_laws", "SELECT count(*) FILTER (WHERE label > 0) AS positives, true AS near_positive, true AS near_negative FROM " + _EVENTS_SQL)
def _balanced_laws(spark, sf):
    e = events(spark, sf)
    bag = sampling.balanced_bagging(e, 4, 0.8, 0.2, 1)
    count = lambda df: df.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    (p, n), (bp, bn) = count(e), count(bag)
    return spark.createDataFrame([(p, _near(bp / p, 0.8, 0.06), _near(bn / n, 0.2, 0.06))], "positives long, near_positive boolean, near_negative boolean")


@query("bagging_by_query_laws", "SELECT count(DISTINCT user_id) AS groups, CAST(0 AS BIGINT) AS cut_groups, true AS near FROM events")
def _by_query_laws(spark, sf):
    e = events(spark, sf)
    bag = sampling.bagging_by_query(e, 4, 0.5, 2).groupBy("group_id").agg(F.count("*").alias("in_bag"))
    sizes = e.groupBy("group_id").agg(F.count("*").alias("n"))
    groups, inside = sizes.count(), bag.count()
    cut = sizes.join(bag, "group_id").where("n <> in_bag").count()
    return spark.createDataFrame([(groups, cut, _near(inside / groups, 0.5, 0.2))], "groups long, cut_groups long, near boolean")


@query(
    "goss_laws",
    f"""WITH r AS (SELECT l_orderkey, abs((1e0 / (1e0 + exp(-s))) - y_bin) AS size FROM {LINES_SQL}),
             u AS (SELECT size, sum(count(*)) OVER (ORDER BY size) AS upto, sum(count(*)) OVER () AS total, count(*) AS n FROM r GROUP BY size),
             c AS (SELECT min(size) AS cut FROM u WHERE upto >= total * (8e-1 - 1e-12))
        SELECT CAST(sum(n) FILTER (WHERE size >= cut) AS BIGINT) AS top_rows, CAST(0 AS BIGINT) AS wrong_weights, true AS near FROM u, c""",
)
def _goss_laws(spark, sf):
    """Every row at or above the exact cut is kept with weight 1, the others with weight 8."""
    rows = lines(spark, sf).withColumn("row_id", F.xxhash64(*_ROW, "l_extendedprice"))
    q = 1.0 / (1.0 + F.exp(-F.col("score")))
    sized = rows.withColumn("size", F.abs(q - F.col("y_bin")))
    kept = sampling.goss(sized, 3, size=F.col("size"))
    top = kept.where("goss_weight = 1")
    low, n, others = top.agg(F.min("size")).first()[0], top.count(), kept.where("goss_weight <> 1")
    wrong = others.where((F.col("size") >= low) | (F.abs(F.col("goss_weight") - 8.0) > 1e-9)).count()
    rest = sized.where(F.col("size") < low).count()
    near = rest == 0 or _near(others.count() / rest, 0.125, 0.03)
    return spark.createDataFrame([(n, wrong, near)], "top_rows long, wrong_weights long, near boolean")


@query("grad_rank_xendcg_laws", "SELECT count(*) AS rows, count(DISTINCT user_id) AS groups, CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS outside FROM events")
def _xendcg_laws(spark, sf):
    """Per group the gradients sum to zero; each hessian is q (1 - q) of a share q."""
    g = objectives.gradients(events(spark, sf), "rank_xendcg")
    sums = g.groupBy("group_id").agg(F.sum("g").alias("g"), F.count("*").alias("n"), F.count_if((F.col("h") < 0) | (F.col("h") > 0.25)).alias("bad"))
    return sums.agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.abs("g") > 1e-9).alias("unbalanced"), F.sum("bad").alias("outside")
    )


@query("predict_sparse_laws", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _sparse_laws(spark, sf):
    """The sparse contributions of a row, the expected value among them, sum to its raw score."""
    keep = [*_ROW, "l_extendedprice"]
    long = predict_sparse(predict_contrib(holed(spark, sf), FIXED_MODEL, keep), keep)
    return _plain(long.groupBy(*keep).agg(to_places(F.sum("value")).alias("raw")))


# --- stored tables read back ---


@query("load_model", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _load_model(spark, sf):
    path = _scratch(spark)
    for name, frame in zip(("nodes", "leaves", "meta"), model.to_tables(spark, FIXED_MODEL)):
        frame.write.parquet(f"{path}/model_{name}")
    return _plain(scoring.predict_raw(holed(spark, sf), model.load_model(spark, path)))


@query("load_binned", f"SELECT l_partkey AS row_id, {_PACKED_SQL} AS bins FROM {_HOLE_SQL}")
def _load_binned(spark, sf):
    """Every binned row and the bins, written and read back.

    Stored rows that the loaded bins would not give again come twice, so a change of either
    table shows.
    """
    path = _scratch(spark)
    rows = [(s.name, s.kind, i, b, None, s.missing_type, 0) for s in _SPECS for i, b in enumerate(s.bounds)]
    rows += [("l_linenumber", "categorical", i, None, c, "none", 0) for i, c in enumerate(_SPECS[3].categories, 1)]
    spark.createDataFrame(rows, SPEC_SCHEMA).write.parquet(f"{path}/bin_spec")
    df = holed(spark, sf).withColumn("row_id", F.col("l_partkey"))
    bin_table(df, _SPECS, ["row_id"], packed=True).write.parquet(f"{path}/binned")
    loaded, specs = tables.load_binned(spark, path)
    found = {s.name: s for s in specs}
    again = bin_table(df, [found[s.name] for s in _SPECS], ["row_id"], packed=True)
    stored = _as_text(loaded)
    return stored.unionByName(stored.exceptAll(_as_text(again)))


@query(
    "read_training_table",
    """SELECT l_quantity + 0e0 AS label, 1e0 + l_linenumber % 3 AS weight, l_extendedprice + 0e0 AS l_extendedprice, l_discount + 0e0 AS l_discount FROM lineitem
       WHERE l_partkey % 17 <> 0""",
)
def _read_training_table(spark, sf):
    """Delimited text written from the table and read back; rows with an odd token are rejected."""
    path = _scratch(spark)
    odd = F.when(F.col("l_partkey") % 17 == 0, F.lit("x1")).otherwise(F.col("l_discount").cast("string"))
    text = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_linenumber") % 3 + 1).alias("w"), "l_extendedprice", odd.alias("l_discount"))
    text.write.option("header", True).csv(path)
    rows, _, _ = tables.read_training_table(spark, path, header=True, label="name:l_quantity", weight="name:w", fmt="csv", row_id=True)
    return rows.drop("row_id")
