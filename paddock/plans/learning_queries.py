"""Metrics, group checks, gradients and feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions.numeric import sigmoid, to_places
from paddock.operators import columns, groups, metrics, objectives
from paddock.operators.position_bias import PositionFactors
from paddock.plans.catalog import query, sql6, table

_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ROW_SQL = ", ".join(_ROW)


def lines(spark, sf):
    """Line items with labels and a fixed score for the row-wise objectives."""
    li = table(spark, sf, "lineitem")
    return li.select(
        *_ROW, "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") / 10000.0).alias("y_reg"),
        F.col("l_quantity").alias("y_count"),
        (F.col("l_returnflag") == "R").cast("double").alias("y_bin"),
        (F.col("l_discount") * 10.0).alias("y_unit"),
        (F.col("l_partkey") % 5).cast("double").alias("y_class"),
        ((F.col("l_partkey") % 13 - 6) / 5.0).alias("score"),
        (1.0 + F.col("l_linenumber") % 3).alias("weight"),
    )


LINES_SQL = f"""(SELECT {_ROW_SQL}, l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice / 1e4 AS y_reg, l_quantity AS y_count,
  CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y_bin, l_discount * 1e1 AS y_unit,
  CAST(l_partkey % 5 AS DOUBLE) AS y_class, (l_partkey % 13 - 6) / 5e0 AS s, 1e0 + l_linenumber % 3 AS w FROM lineitem)"""

_SIG = "(1e0 / (1e0 + exp(-s)))"
_SOFTPLUS = "(greatest(s, 0e0) + ln(1e0 + exp(-abs(s))))"
_Z = f"(1e0 - exp(-w * {_SOFTPLUS}))"

# name: (label column, objective, gradient SQL, hessian SQL)
_GRADIENTS = {
    "regression": ("y_reg", "s - y", "1e0"),
    "regression_l1": ("y_reg", "sign(s - y)", "1e0"),
    "huber": ("y_reg", "greatest(least(s - y, 9e-1), -9e-1)", "1e0"),
    "fair": ("y_reg", "(s - y) / (abs(s - y) + 1e0)", "1e0 / ((abs(s - y) + 1e0) * (abs(s - y) + 1e0))"),
    "poisson": ("y_count", "exp(s) - y", "exp(s + 7e-1)"),
    "quantile": ("y_reg", "CASE WHEN s >= y THEN 1e-1 ELSE -9e-1 END", "1e0"),
    "mape": ("y_reg", "sign(s - y) / greatest(1e0, abs(y))", "1e0 / greatest(1e0, abs(y))"),
    "gamma": ("y_reg", "1e0 - y * exp(-s)", "y * exp(-s)"),
    "tweedie": (
        "y_count", "-y * exp(-5e-1 * s) + exp(5e-1 * s)", "y * 5e-1 * exp(-5e-1 * s) + 5e-1 * exp(5e-1 * s)",
    ),
    "binary": ("y_bin", f"{_SIG} - y", f"{_SIG} * (1e0 - {_SIG})"),
    "cross_entropy": ("y_unit", f"{_SIG} - y", f"{_SIG} * (1e0 - {_SIG})"),
    "cross_entropy_lambda": (
        "y_unit",
        f"w * {_SIG} * ({_Z} - y) / {_Z}",
        f"w * {_SIG} * (1e0 - {_SIG}) * (1e0 - y / {_Z}) + y * w * w * {_SIG} * {_SIG} * (1e0 - {_Z}) / ({_Z} * {_Z})",
    ),
    "custom": ("y_reg", "4e0 * (s - y) * (s - y) * (s - y)", "12e0 * (s - y) * (s - y)"),
}


def _quartic(score, label):
    d = score - label
    return 4.0 * d * d * d, 12.0 * d * d


def _gradient_query(name: str, label: str):
    weighted = "weight" if name == "cross_entropy_lambda" else None
    params = objectives.ObjectiveParams(custom=_quartic)

    def run(spark, sf):
        df = lines(spark, sf).withColumn("label", F.col(label))
        out = objectives.gradients(df, name, params, weight=weighted)
        return out.select(*_ROW, to_places(F.col("g")).alias("g"), to_places(F.col("h")).alias("h"))

    return run


for _name, (_label, _g, _h) in _GRADIENTS.items():
    query(
        f"grad_{_name}",
        f"SELECT {_ROW_SQL}, {sql6(_g)} AS g, {sql6(_h)} AS h FROM (SELECT *, {_label} AS y FROM {LINES_SQL})",
    )(_gradient_query(_name, _label))

# Five class scores per row, from the row's own numbers.
_CLASS_SCORES_SQL = [f"((l_partkey * {k + 2} + l_suppkey) % 11 - 5) / 4e0" for k in range(5)]


def _class_scores():
    return F.array(*[((F.col("l_partkey") * (k + 2) + F.col("l_suppkey")) % 11 - 5) / 4.0 for k in range(5)])


def _class_sql(g, h):
    return " UNION ALL ".join(
        f"SELECT {_ROW_SQL}, {k} AS class_id, {sql6(g.format(k=k))} AS g, {sql6(h.format(k=k))} AS h FROM "
        f"(SELECT *, {', '.join(f'exp({e}) AS e{i}, {e} AS s{i}' for i, e in enumerate(_CLASS_SCORES_SQL))} FROM {LINES_SQL})"
        for k in range(5)
    )


_SOFT = "(e{k} / (e0 + e1 + e2 + e3 + e4))"
_HOT = "(CASE WHEN y_class = {k} THEN 1e0 ELSE 0e0 END)"
_OVA = "(1e0 / (1e0 + exp(-s{k})))"


def _class_query(objective):
    def run(spark, sf):
        p = objectives.ObjectiveParams(num_class=5)
        df = lines(spark, sf).withColumn("score", _class_scores()).withColumn("label", F.col("y_class"))
        out = objectives.gradients(df, objective, p)
        pairs = F.arrays_zip("g", "h")
        long = out.select(*_ROW, F.posexplode(pairs).alias("class_id", "gh"))
        return long.select(*_ROW, "class_id", to_places(F.col("gh.g")).alias("g"), to_places(F.col("gh.h")).alias("h"))

    return run


query("grad_multiclass", _class_sql(f"{_SOFT} - {_HOT}", f"2e0 * {_SOFT} * (1e0 - {_SOFT})"))(_class_query("multiclass"))
query("grad_multiclassova", _class_sql(f"{_OVA} - {_HOT}", f"{_OVA} * (1e0 - {_OVA})"))(_class_query("multiclassova"))


# --- ranking: events by user ---

_EVENTS_SQL = """(SELECT event_id AS row_id, user_id AS group_id,
    CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS DOUBLE) AS label,
    floor(value) % 17 / 4e0 AS score, 1e0 + event_id % 2 AS weight FROM events)"""


def events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    label = F.when(kind == "purchase", 3.0).when(kind == "signup", 2.0).when(kind == "click", 1.0).otherwise(0.0)
    return e.select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("group_id"), label.alias("label"),
        (F.floor("value") % 17 / 4.0).alias("score"), (1.0 + F.col("event_id") % 2).alias("weight"),
    )


def lambdarank_sql(rows: str) -> str:
    """SQL of the ranking gradients of `rows` (row_id, group_id, label, score): all their columns, g and h."""
    return f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, row_id) AS rk,
                          row_number() OVER (PARTITION BY group_id ORDER BY label DESC, row_id) AS bk,
                          max(score) OVER (PARTITION BY group_id) AS top, min(score) OVER (PARTITION BY group_id) AS bottom,
                          pow(2e0, label) - 1e0 AS gain FROM {rows}),
         m AS (SELECT group_id, sum(gain / log2(1e0 + bk)) AS best FROM r WHERE bk <= 30 GROUP BY group_id),
         p AS (SELECT a.group_id, a.row_id AS hi, b.row_id AS lo,
                      abs(a.gain - b.gain) * abs(1e0 / log2(1e0 + a.rk) - 1e0 / log2(1e0 + b.rk)) / best
                      / CASE WHEN a.top <> a.bottom THEN 1e-2 + abs(a.score - b.score) ELSE 1e0 END AS delta,
                      1e0 / (1e0 + exp(a.score - b.score)) AS rho
               FROM r a JOIN r b ON a.group_id = b.group_id AND a.label > b.label AND least(a.rk, b.rk) <= 30
               JOIN m ON m.group_id = a.group_id WHERE best > 0),
         f AS (SELECT group_id, hi AS row_id, -delta * rho AS g, delta * rho * (1e0 - rho) AS h FROM p
               UNION ALL SELECT group_id, lo, delta * rho, delta * rho * (1e0 - rho) FROM p),
         t AS (SELECT group_id, sum(abs(g)) AS total FROM f GROUP BY group_id),
         c AS (SELECT row_id, sum(g) AS g, sum(h) AS h FROM f GROUP BY row_id)
       SELECT r.*, coalesce(g, 0e0) * CASE WHEN total > 0 THEN log2(1e0 + total) / total ELSE 1e0 END AS g,
              coalesce(h, 0e0) * CASE WHEN total > 0 THEN log2(1e0 + total) / total ELSE 1e0 END AS h
       FROM r LEFT JOIN c ON c.row_id = r.row_id LEFT JOIN t ON t.group_id = r.group_id)"""


@query("grad_lambdarank", f"SELECT row_id, {sql6('g')} AS g, {sql6('h')} AS h FROM {lambdarank_sql(_EVENTS_SQL)}")
def _grad_lambdarank(spark, sf):
    out = objectives.gradients(events(spark, sf), "lambdarank")
    return out.select("row_id", to_places(F.col("g")).alias("g"), to_places(F.col("h")).alias("h"))


# Events shown at eleven positions; every twelfth event has none.
_POSITION_SQL = "CASE WHEN row_id % 12 < 11 THEN row_id % 12 END"


def positioned(spark, sf):
    place = F.col("row_id") % 12
    return events(spark, sf).withColumn("position", F.when(place < 11, place))


def position_step_sql(score: str, factor: str, rate: str, pull: str) -> str:
    """SQL of one Newton step of the factors: (position, n, factor), unrounded."""
    rows = (
        f"(SELECT * REPLACE ({score} + coalesce({factor}, 0e0) AS score) FROM (SELECT *, {_POSITION_SQL} AS position FROM {_EVENTS_SQL}))"
    )
    return f"""(SELECT position, count(*) AS n,
        {factor} - {rate} * (sum(g) + {pull} * count(*) * {factor}) / (sum(h) + {pull} * count(*) + 1e-3) AS factor
        FROM {lambdarank_sql(rows)} WHERE position IS NOT NULL GROUP BY position)"""


@query(
    "position_bias_step",
    f"SELECT position, {sql6('factor')} AS factor FROM {position_step_sql('score', '(position / 8e0 - 5e-1)', '25e-2', '125e-3')}",
)
def _position_bias_step(spark, sf):
    """Gradients at scores raised by given factors, then one step of every factor."""
    rows = positioned(spark, sf)
    known = rows.where("position IS NOT NULL").select("position").distinct()
    factors = PositionFactors(known.select("position", (F.col("position") / 8.0 - 0.5).alias("factor")))
    moved = factors.stepped(objectives.gradients(factors.added_to(rows), "lambdarank"), 0.25, 0.125)
    return moved.table.select("position", to_places(F.col("factor")).alias("factor"))


@query("grad_rank_xendcg")
def _grad_rank_xendcg(spark, sf):
    out = objectives.gradients(events(spark, sf), "rank_xendcg")
    return out.select("row_id", "group_id", "g", "h")


# --- pointwise metrics ---

_Q = "(1e0 / (1e0 + exp(-s)))"
_CLIP = "least(greatest({p}, 1e-15), 1e0 - 1e-15)"
_CROSS = "-(y * ln({c}) + (1e0 - y) * ln(1e0 - {c}))".format(c=_CLIP.format(p=_Q))
_YLOGY = "(CASE WHEN y > 0 THEN y * ln(y) ELSE 0e0 END + CASE WHEN y < 1 THEN (1e0 - y) * ln(1e0 - y) ELSE 0e0 END)"

# name: (label, prediction in Spark as raw|exp|sigmoid, loss SQL of y, p)
_METRICS = {
    "l1": ("y_reg", "raw", "abs(p - y)"),
    "l2": ("y_reg", "raw", "(p - y) * (p - y)"),
    "rmse": ("y_reg", "raw", "(p - y) * (p - y)"),
    "quantile": ("y_reg", "raw", "CASE WHEN y - p < 0 THEN (9e-1 - 1e0) * (y - p) ELSE 9e-1 * (y - p) END"),
    "mape": ("y_reg", "raw", "abs(y - p) / greatest(1e0, abs(y))"),
    "huber": ("y_reg", "raw", "CASE WHEN abs(p - y) <= 9e-1 THEN 5e-1 * (p - y) * (p - y) ELSE 9e-1 * (abs(p - y) - 45e-2) END"),
    "fair": ("y_reg", "raw", "abs(p - y) - ln(1e0 + abs(p - y))"),
    "poisson": ("y_count", "exp", "p - y * ln(p)"),
    "gamma": ("y_count", "exp", "y / p + ln(p)"),
    "gamma_deviance": ("y_count", "exp", "2e0 * (y / p - ln(y / p) - 1e0)"),
    "tweedie": ("y_count", "exp", "y * pow(p, -5e-1) / 5e-1 + pow(p, 5e-1) / 5e-1"),
    "binary_logloss": ("y_bin", "sigmoid", "-ln(CASE WHEN y > 0 THEN p ELSE 1e0 - p END)"),
    "binary_error": ("y_bin", "sigmoid", "CASE WHEN (p > 5e-1) <> (y > 0) THEN 1e0 ELSE 0e0 END"),
    "cross_entropy": ("y_unit", "sigmoid", "-(y * ln(p) + (1e0 - y) * ln(1e0 - p))"),
    "kullback_leibler": ("y_unit", "sigmoid", f"-(y * ln(p) + (1e0 - y) * ln(1e0 - p)) + {_YLOGY}"),
}
_SHAPE_SQL = {"raw": "s", "exp": "exp(s)", "sigmoid": _Q}
_SHAPE = {"raw": lambda s: s, "exp": F.exp, "sigmoid": sigmoid}


def _metric_query(name, label, shape):
    def run(spark, sf):
        df = lines(spark, sf).select(F.col(label).alias("label"), _SHAPE[shape](F.col("score")).alias("prediction"), "weight")
        return metrics.evaluate(df, name, weight="weight").select("metric", to_places(F.col("value")).alias("value"))

    return run


for _name, (_label, _shape, _loss) in _METRICS.items():
    _value = f"sum(w * ({_loss})) / sum(w)"
    query(
        f"metric_{_name}",
        f"SELECT '{_name}' AS metric, {sql6(f'sqrt({_value})' if _name == 'rmse' else _value)} AS value "
        f"FROM (SELECT *, {_label} AS y, {_SHAPE_SQL[_shape]} AS p FROM {LINES_SQL})",
    )(_metric_query(_name, _label, _shape))


@query(
    "metric_cross_entropy_lambda",
    f"SELECT 'cross_entropy_lambda' AS metric, {sql6(f'avg(-(y_unit * ln({_Z}) + (1e0 - y_unit) * ln(1e0 - {_Z})))')} AS value FROM {LINES_SQL}",
)
def _metric_xel(spark, sf):
    df = lines(spark, sf).select(F.col("y_unit").alias("label"), F.col("score").alias("raw"), "weight")
    return metrics.evaluate(df, "cross_entropy_lambda", weight="weight").select("metric", to_places(F.col("value")).alias("value"))


_SCORED_SQL = "(SELECT quality AS y, n_chars % 101 / 1e2 AS p, 1e0 + doc_id % 2 AS w FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") % 101 / 100.0).alias("prediction"),
        (1.0 + F.col("doc_id") % 2).alias("weight"), "toxic",
    )


@query(
    "metric_auc",
    f"""SELECT 'auc' AS metric, {sql6("sum(pw * (nw_upto - nw / 2e0)) / (sum(pw) * sum(nw))")} AS value FROM
        (SELECT *, sum(nw) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS nw_upto FROM
         (SELECT p, sum(CASE WHEN y > 0 THEN w ELSE 0e0 END) AS pw, sum(CASE WHEN y > 0 THEN 0e0 ELSE w END) AS nw FROM {_SCORED_SQL} GROUP BY p))""",
)
def _metric_auc(spark, sf):
    return metrics.auc(_scored(spark, sf), weight="weight").select("metric", to_places(F.col("value")).alias("value"))


@query(
    "metric_average_precision",
    f"""SELECT 'average_precision' AS metric, {sql6("sum(pw * pw_upto / all_upto) / sum(pw)")} AS value FROM
        (SELECT *, sum(pw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS pw_upto, sum(pw + nw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS all_upto FROM
         (SELECT p, sum(CASE WHEN y > 0 THEN w ELSE 0e0 END) AS pw, sum(CASE WHEN y > 0 THEN 0e0 ELSE w END) AS nw FROM {_SCORED_SQL} GROUP BY p))""",
)
def _metric_ap(spark, sf):
    out = metrics.average_precision(_scored(spark, sf), weight="weight")
    return out.select("metric", to_places(F.col("value")).alias("value"))


# A score per class from the whole vector: the sum of the places that are the class modulo 10.
_CLASS_SUM = "list_transform(range(0, 10), lambda k: round(list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: (i - 1) % 10 = k), lambda i: CAST(embedding[i] AS DOUBLE))), 9))"
_EMBED_SQL = f"(SELECT vec_id, label, list_transform({_CLASS_SUM}, lambda x: exp(x)) AS e FROM embeddings)"
_EMBED_P_SQL = f"(SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM {_EMBED_SQL})"


def _class_sums():
    def total(k):
        own = F.filter("embedding", lambda x, i: i % 10 == k)
        return F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")), 9)

    return F.array(*[total(k) for k in range(10)])


def _class_probabilities(spark, sf):
    e = table(spark, sf, "embeddings")
    grown = F.transform(_class_sums(), F.exp)
    total = F.aggregate(F.col("e"), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "label", grown.alias("e")).select(
        "vec_id", "label", F.transform("e", lambda x: x / total).alias("probabilities")
    )


@query(
    "metric_auc_mu",
    f"""WITH c AS (SELECT label, {_CLASS_SUM} AS e FROM embeddings),
             q AS (SELECT a.i, b.j, label, e[b.j + 1] AS pj, e[a.i + 1] AS pi
                   FROM c, range(0, 10) a(i), range(0, 10) b(j) WHERE a.i < b.j AND label IN (a.i, b.j)),
             s AS (SELECT i, j, CASE WHEN label = i THEN 1e0 ELSE 0e0 END AS pos, pi - pj AS v FROM q),
             u AS (SELECT x.i, x.j, avg(CASE WHEN x.v > y.v THEN 1e0 WHEN x.v = y.v THEN 5e-1 ELSE 0e0 END) AS area
                   FROM s x JOIN s y ON x.i = y.i AND x.j = y.j AND x.pos = 1 AND y.pos = 0 GROUP BY x.i, x.j)
        SELECT 'auc_mu' AS metric, {sql6("sum(area) / 45")} AS value FROM u""",
)
def _metric_auc_mu(spark, sf):
    e = table(spark, sf, "embeddings").select("label", _class_sums().alias("scores"))
    return metrics.auc_mu(e, 10).select("metric", to_places(F.col("value")).alias("value"))


@query("metric_multi_logloss", f"SELECT 'multi_logloss' AS metric, {sql6('avg(-ln(p[label + 1]))')} AS value FROM {_EMBED_P_SQL}")
def _metric_multi_logloss(spark, sf):
    return metrics.multi_logloss(_class_probabilities(spark, sf)).select("metric", to_places(F.col("value")).alias("value"))


def _multi_error_sql(k):
    name = "multi_error" if k == 1 else f"multi_error@{k}"
    wrong = f"CASE WHEN len(list_filter(p, lambda x: x < p[label + 1])) < 10 - {k} THEN 1e0 ELSE 0e0 END"
    return f"SELECT '{name}' AS metric, {sql6(f'avg({wrong})')} AS value FROM {_EMBED_P_SQL}"


@query("metric_multi_error", _multi_error_sql(1))
def _metric_multi_error(spark, sf):
    return metrics.evaluate(_class_probabilities(spark, sf), "multi_error").select("metric", to_places(F.col("value")).alias("value"))


@query("metric_multi_error_at_k", _multi_error_sql(3))
def _metric_multi_error_k(spark, sf):
    return metrics.evaluate(_class_probabilities(spark, sf), "multi_error@3").select("metric", to_places(F.col("value")).alias("value"))


_DCG = """(SELECT group_id, sum(CASE WHEN rk <= {k} THEN (pow(2e0, label) - 1e0) / log2(1e0 + rk) ELSE 0e0 END) AS dcg,
    sum(CASE WHEN bk <= {k} THEN (pow(2e0, label) - 1e0) / log2(1e0 + bk) ELSE 0e0 END) AS best FROM
    (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, row_id) AS rk,
            row_number() OVER (PARTITION BY group_id ORDER BY label DESC) AS bk FROM {e}) GROUP BY group_id)"""


@query(
    "metric_ndcg",
    f"SELECT 'ndcg@5' AS metric, {sql6('avg(CASE WHEN best > 0 THEN dcg / best ELSE 1e0 END)')} AS value FROM {_DCG.format(k=5, e=_EVENTS_SQL)}",
)
def _metric_ndcg(spark, sf):
    return metrics.evaluate(events(spark, sf), "ndcg@5").select("metric", to_places(F.col("value")).alias("value"))


@query("max_dcg", f"SELECT group_id, {sql6('best')} AS max_dcg FROM {_DCG.format(k=10, e=_EVENTS_SQL)}")
def _max_dcg(spark, sf):
    return metrics.max_dcg(events(spark, sf), 10).select("group_id", to_places(F.col("max_dcg")).alias("max_dcg"))


@query(
    "metric_map",
    f"""SELECT 'map@5' AS metric, {sql6("avg(CASE WHEN rel > 0 THEN prec / least(rel, 5) ELSE 1e0 END)")} AS value FROM
        (SELECT group_id, sum(hit) AS rel, sum(CASE WHEN rk <= 5 AND hit = 1 THEN hits * 1e0 / rk ELSE 0e0 END) AS prec FROM
         (SELECT group_id, rk, hit, sum(hit) OVER (PARTITION BY group_id ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM
          (SELECT group_id, CASE WHEN label > 0 THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, row_id) AS rk FROM {_EVENTS_SQL}))
         GROUP BY group_id)""",
)
def _metric_map(spark, sf):
    return metrics.evaluate(events(spark, sf), "map@5").select("metric", to_places(F.col("value")).alias("value"))


@query(
    "eval_all",
    " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, metric, {sql6('value')} AS value FROM (SELECT 'l2' AS metric, avg((p - y) * (p - y)) AS value FROM {src} "
        f"UNION ALL SELECT 'binary_error', avg(CASE WHEN (p > 5e-1) <> (y > 0) THEN 1e0 ELSE 0e0 END) FROM {src} "
        f"UNION ALL SELECT 'auc', (SELECT avg(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 5e-1 ELSE 0e0 END) FROM {src} a, {src} b WHERE a.y > 0 AND b.y = 0))"
        for name, src in (
            ("train", _SCORED_SQL),
            ("valid", "(SELECT toxic AS y, n_chars % 101 / 1e2 AS p FROM labels JOIN documents USING (doc_id))"),
        )
    ),
)
def _eval_all(spark, sf):
    train = _scored(spark, sf)
    valid = train.withColumn("label", F.col("toxic"))
    out = metrics.eval_all({"train": train, "valid": valid}, ["l2", "binary_error", "auc"])
    return out.select("dataset", "metric", to_places(F.col("value")).alias("value"))


# --- groups and labels ---


@query(
    "query_boundaries",
    """SELECT user_id AS group_id, n AS size, CAST(sum(n) OVER (ORDER BY user_id) - n AS BIGINT) AS first_row,
              CAST(sum(n) OVER (ORDER BY user_id) AS BIGINT) AS end_row FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""",
)
def _query_boundaries(spark, sf):
    return groups.query_boundaries(events(spark, sf))


@query("query_weights", f"SELECT group_id, {sql6('avg(weight)')} AS query_weight FROM {_EVENTS_SQL} GROUP BY group_id")
def _query_weights(spark, sf):
    return groups.query_weights(events(spark, sf)).withColumn("query_weight", to_places(F.col("query_weight")))


@query("position_ids", "SELECT DISTINCT l_suppkey AS position, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS position_id FROM lineitem")
def _position_ids(spark, sf):
    return groups.position_ids(table(spark, sf, "lineitem"), "l_suppkey").withColumnRenamed("l_suppkey", "position")


@query("init_score", f"SELECT {_ROW_SQL}, CASE WHEN l_partkey % 7 = 0 THEN 0e0 ELSE s END AS init_score FROM {LINES_SQL}")
def _init_score(spark, sf):
    df = lines(spark, sf).select(*_ROW, F.when(F.col("l_partkey") % 7 != 0, F.col("score")).alias("init_score"))
    return groups.init_scores(df)


@query("label_check", 'SELECT 0e0 AS "min", max(label) AS "max", sum(label) AS "sum", count(*) FILTER (label >= 3) AS violations FROM ' + _EVENTS_SQL)
def _label_check(spark, sf):
    return groups.label_check(events(spark, sf), 0, 31, whole=True, gains=3)


@query("class_counts", "SELECT quality AS label, count(*) AS rows FROM labels GROUP BY quality")
def _class_counts(spark, sf):
    return groups.class_counts(table(spark, sf, "labels").withColumnRenamed("quality", "label"))


@query("boost_from_average", f"SELECT {sql6('ln(avg(y_bin) / (1e0 - avg(y_bin)))')} AS start FROM {LINES_SQL}")
def _boost_from_average(spark, sf):
    out = objectives.start_score(lines(spark, sf), "binary", label="y_bin")
    return out.select(to_places(F.col("start")).alias("start"))


# --- feature tables ---


@query(
    "arrow_nulls_to_nan",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN 0e0 ELSE l_suppkey END AS a,
              CASE WHEN l_partkey % 7 = 0 THEN -1e0 ELSE l_quantity END AS b, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS c FROM lineitem""",
)
def _nulls_to_nan(spark, sf):
    holed = lambda c: F.when(F.col("l_partkey") % 7 != 0, F.col(c))
    df = table(spark, sf, "lineitem").select(
        *_ROW, holed("l_suppkey").alias("a"), holed("l_quantity").alias("b"), (F.col("l_returnflag") == "R").alias("c")
    )
    return columns.nulls_to_nan(df, ["a", "b", "c"]).withColumn("b", F.nanvl("b", F.lit(-1.0)))


@query(
    "concat_matrices",
    "SELECT o_orderkey AS id, o_totalprice AS x FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT p_partkey, p_retailprice FROM part",
)
def _concat_matrices(spark, sf):
    pick = lambda t, i, x: table(spark, sf, t).select(F.col(i).alias("id"), F.col(x).alias("x"))
    return columns.concat_matrices(
        [pick("orders", "o_orderkey", "o_totalprice"), pick("customer", "c_custkey", "c_acctbal"), pick("part", "p_partkey", "p_retailprice")]
    )


@query(
    "sparse_to_dense",
    "SELECT l_orderkey AS row_id, " + ", ".join(f"coalesce(max(CASE WHEN l_linenumber = {i} THEN l_extendedprice END), 0e0) AS f{i}" for i in range(1, 6))
    + " FROM lineitem GROUP BY l_orderkey",
)
def _sparse_to_dense(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), (F.col("l_linenumber") - 1).alias("feature"), F.col("l_extendedprice").alias("value")
    )
    return columns.sparse_to_dense(t, [f"f{i}" for i in range(1, 6)])


_FEATURES = ["l_quantity", "l_discount", "l_tax", "same"]


@query(
    "drop_constant_features",
    "SELECT 'l_quantity' AS feature, true AS keep UNION ALL SELECT 'l_discount', true UNION ALL SELECT 'l_tax', true UNION ALL SELECT 'same', count(*) < 0 FROM lineitem",
)
def _drop_constant(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("same", F.lit(7.0))
    return columns.drop_constant_features(df, _FEATURES)


@query(
    "drop_unsplittable_features",
    " UNION ALL ".join(
        f"SELECT '{name}' AS feature, bool_or(upto >= 5000 AND total - upto >= 5000) AS keep FROM "
        f"(SELECT sum(count(*)) OVER (ORDER BY {value}) AS upto, (SELECT count(*) FROM lineitem) AS total FROM lineitem GROUP BY {value})"
        for name, value in (("l_quantity", "l_quantity"), ("rare", "(l_partkey % 97 = 0)"))
    ),
)
def _drop_unsplittable(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("rare", (F.col("l_partkey") % 97 == 0).cast("double"))
    return columns.drop_constant_features(df, ["l_quantity", "rare"], 5000)


@query(
    "feature_infos",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, '[' || CAST(min({c}) + 0e0 AS VARCHAR) || ':' || CAST(max({c}) + 0e0 AS VARCHAR) || ']' AS info FROM lineitem" for c in _FEATURES[:3])
    + " UNION ALL SELECT 'same', 'none'"
    + " UNION ALL SELECT 'nation', string_agg(CAST(c AS VARCHAR), ':' ORDER BY n DESC, c) FROM (SELECT c_nationkey AS c, count(*) AS n FROM customer GROUP BY 1)",
)
def _feature_infos(spark, sf):
    from paddock.operators.binning import find_category_bins

    df = table(spark, sf, "lineitem").withColumn("same", F.lit(7.0))
    cats = table(spark, sf, "customer").select(F.lit("nation").alias("feature"), F.col("c_nationkey").cast("double").alias("value"))
    return columns.feature_infos(df, _FEATURES, find_category_bins(cats))


@query("row_subset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _row_subset(spark, sf):
    keep = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return columns.row_subset(table(spark, sf, "orders"), keep, "o_custkey").select("o_orderkey", "o_totalprice")


@query("add_feature_columns", "SELECT doc_id AS row_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _add_feature_columns(spark, sf):
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return columns.add_feature_columns(left, right)
