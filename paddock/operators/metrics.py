"""Evaluation metrics as aggregations and windows.

Every function takes a DataFrame and returns one row (metric, value) unless it says
otherwise. `weight` is a column or None; when present it weights each loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.functions.numeric import safe_log, softplus
from paddock.operators.prefix import running_totals

Loss = Callable[[Column, Column], Column]

# Fixed value: probabilities stay this far away from 0 and 1 inside a logarithm.
EDGE = 1e-15


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1.0 - EDGE))


def _binary_cross(y: Column, p: Column) -> Column:
    q = clip(p)
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def _y_log_y(y: Column) -> Column:
    return F.when(y > 0, y * F.log(y)).otherwise(0.0) + F.when(y < 1, (1.0 - y) * F.log(1.0 - y)).otherwise(0.0)


def pointwise_losses(alpha: float = 0.9, fair_c: float = 1.0, rho: float = 1.5) -> dict[str, Loss]:
    """Row losses by metric name, of label and transformed prediction."""
    return {
        "l1": lambda y, p: F.abs(p - y),
        "l2": lambda y, p: (p - y) * (p - y),
        "rmse": lambda y, p: (p - y) * (p - y),
        "quantile": lambda y, p: F.when(y - p < 0, (alpha - 1.0) * (y - p)).otherwise(alpha * (y - p)),
        "mape": lambda y, p: F.abs(y - p) / F.greatest(F.lit(1.0), F.abs(y)),
        "huber": lambda y, p: F.when(F.abs(p - y) <= alpha, 0.5 * (p - y) * (p - y)).otherwise(
            alpha * (F.abs(p - y) - 0.5 * alpha)
        ),
        "fair": lambda y, p: fair_c * F.abs(p - y) - fair_c * fair_c * F.log1p(F.abs(p - y) / fair_c),
        "poisson": lambda y, p: F.greatest(p, F.lit(1e-10)) - y * safe_log(F.greatest(p, F.lit(1e-10))),
        "gamma": lambda y, p: y / p + safe_log(p),
        "gamma_deviance": lambda y, p: 2.0 * (y / p - safe_log(y / p) - 1.0),
        "tweedie": lambda y, p: -y * F.pow(F.greatest(p, F.lit(1e-10)), F.lit(1.0 - rho)) / (1.0 - rho)
        + F.pow(F.greatest(p, F.lit(1e-10)), F.lit(2.0 - rho)) / (2.0 - rho),
        "binary_logloss": lambda y, p: -F.log(clip(F.when(y > 0, p).otherwise(1.0 - p))),
        "binary_error": lambda y, p: ((p > 0.5) != (y > 0)).cast("double"),
        "cross_entropy": _binary_cross,
        "kullback_leibler": lambda y, p: _binary_cross(y, p) + _y_log_y(y),
    }


# Metrics for which more is better.
LARGER_IS_BETTER = ("auc", "auc_mu", "average_precision", "ndcg", "map")


def larger_is_better(metric: str) -> bool:
    return metric.split("@")[0] in LARGER_IS_BETTER


def _mean(df: DataFrame, name: str, loss: Column, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    value = F.sum(w * loss) / F.sum(w)
    value = F.sqrt(value) if name == "rmse" else value
    return df.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value")


def pointwise(
    df: DataFrame, name: str, label: str = "label", prediction: str = "prediction", weight: str | None = None, **params
) -> DataFrame:
    loss = pointwise_losses(**params)[name]
    return _mean(df, name, loss(F.col(label).cast("double"), F.col(prediction)), weight)


def cross_entropy_lambda(df: DataFrame, label: str = "label", raw: str = "raw", weight: str | None = None) -> DataFrame:
    """Cross entropy with p = 1 - exp(-w * softplus(raw)); the weight acts inside p."""
    w = F.col(weight) if weight else F.lit(1.0)
    p = 1.0 - F.exp(-w * softplus(F.col(raw)))
    return _mean(df, "cross_entropy_lambda", _binary_cross(F.col(label).cast("double"), p), None)


def _class_totals(df: DataFrame, label: str, score: str, weight: str | None, group: list[str] = ()) -> DataFrame:
    """Positive and negative weight per distinct score: equal scores combine before any order."""
    w = F.col(weight) if weight else F.lit(1.0)
    positive = F.col(label) > 0
    return df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(F.when(positive, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(positive, 0.0).otherwise(w)).alias("neg"),
    )


def auc(df: DataFrame, label: str = "label", score: str = "prediction", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting one half.

    Only distinct scores are ordered, by a range-partitioned running total.
    """
    totals = _class_totals(df, label, score, weight)
    below = running_totals(totals, [], [F.col("score")], {"neg_upto": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("neg_upto") - 0.5 * F.col("neg")))
    area = won / (F.sum("pos") * F.sum("neg"))
    # Without both classes there is nothing to rank: the area counts as one.
    value = F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area).otherwise(F.lit(1.0))
    return below.agg(value.alias("value")).select(F.lit("auc").alias("metric"), "value")


def average_precision(df: DataFrame, label: str = "label", score: str = "prediction", weight: str | None = None) -> DataFrame:
    """Sum over distinct scores, from the top, of precision times gained recall."""
    totals = _class_totals(df, label, score, weight)
    upto = running_totals(
        totals, [], [F.col("score").desc()], {"pos_upto": F.col("pos"), "all_upto": F.col("pos") + F.col("neg")}
    )
    summed = F.sum(F.col("pos") * F.col("pos_upto") / F.col("all_upto")) / F.sum("pos")
    value = F.when(F.sum("pos") > 0, summed).otherwise(F.lit(1.0))
    return upto.agg(value.alias("value")).select(F.lit("average_precision").alias("metric"), "value")


def auc_mu(
    df: DataFrame, classes: int, label: str = "label", scores: str = "scores", weights: list[list[float]] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Mean over class pairs of the AUC along the direction that separates the pair.

    A row joins the classes - 1 pairs of its own class, a fixed number set by the model.
    """
    cost = weights or [[0.0 if i == j else 1.0 for j in range(classes)] for i in range(classes)]
    pairs = [(i, j) for i in range(classes) for j in range(i + 1, classes)]
    y, s = F.col(label).cast("int"), F.col(scores)
    row_weight = F.col(weight).cast("double") if weight else F.lit(1.0)

    def along(i: int, j: int) -> Column:
        terms = [(cost[j][k] - cost[i][k], k) for k in range(classes)]
        first, *rest = [F.lit(c) * s[k] for c, k in terms if c != 0.0]
        for term in rest:
            first = first + term
        return first

    cells = [
        F.when(
            y.isin(i, j),
            F.struct(F.lit(n).alias("pair"), (y == i).cast("double").alias("is_first"), along(i, j).alias("score"), row_weight.alias("w")),
        )
        for n, (i, j) in enumerate(pairs)
    ]
    long = df.select(F.inline(F.array_compact(F.array(*cells))))
    totals = _class_totals(long, "is_first", "score", "w", ["pair"])
    below = running_totals(totals, ["pair"], [F.col("score")], {"neg_upto": F.col("neg")})
    areas = below.groupBy("pair").agg(
        (F.sum(F.col("pos") * (F.col("neg_upto") - 0.5 * F.col("neg"))) / (F.sum("pos") * F.sum("neg"))).alias("area")
    )
    return areas.agg((F.sum(F.coalesce("area", F.lit(0.0))) / len(pairs)).alias("value")).select(
        F.lit("auc_mu").alias("metric"), "value"
    )


def multi_logloss(df: DataFrame, label: str = "label", probabilities: str = "probabilities", weight: str | None = None) -> DataFrame:
    p = F.element_at(F.col(probabilities), F.col(label).cast("int") + 1)
    return _mean(df, "multi_logloss", -F.log(clip(p)), weight)


def multi_error(
    df: DataFrame, k: int = 1, label: str = "label", probabilities: str = "probabilities", weight: str | None = None
) -> DataFrame:
    """Right when at least classes - k predictions are strictly below the true one's."""
    own = F.element_at(F.col(probabilities), F.col(label).cast("int") + 1)
    below = F.size(F.filter(probabilities, lambda p: p < own))
    wrong = (below < F.size(probabilities) - k).cast("double")
    return _mean(df, "multi_error" if k == 1 else f"multi_error@{k}", wrong, weight)


def label_gain(label: Column, gains: list[float] | None = None) -> Column:
    """Gain of a relevance label: 2^label - 1 unless a table is given."""
    if gains is None:
        return F.pow(F.lit(2.0), label.cast("double")) - 1.0
    return F.get(F.array(*[F.lit(float(g)) for g in gains]), label.cast("int"))


def discount(rank: Column) -> Column:
    """Of a one-based rank."""
    return 1.0 / F.log2(1.0 + rank)


def _top_dcg(df: DataFrame, group: str, order: list[Column], k: int, gains: list[float] | None, name: str) -> DataFrame:
    """DCG of the first k rows per group. The row-number filter lets Spark drop all but k
    rows of a group before the shuffle, so a hot group stays small."""
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__r") <= k)
    return ranked.groupBy(group).agg(F.sum(label_gain(F.col("label"), gains) * discount(F.col("__r"))).alias(name))


def max_dcg(df: DataFrame, k: int, group: str = "group_id", gains: list[float] | None = None) -> DataFrame:
    """(group, max_dcg): the DCG at k of the best possible order."""
    return _top_dcg(df.select(group, "label"), group, [F.col("label").desc()], k, gains, "max_dcg")


def ndcg(
    df: DataFrame, k: int, group: str = "group_id", tie: str = "row_id", gains: list[float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Mean NDCG at k over groups; a group without any gain counts as 1. `weight` is a group weight."""
    columns = [group, tie, "label", "score"]
    got = _top_dcg(df.select(*columns), group, [F.col("score").desc(), F.col(tie)], k, gains, "dcg")
    best = max_dcg(df, k, group, gains)
    each = got.join(best, group).withColumn(
        "ndcg", F.when(F.col("max_dcg") > 0, F.col("dcg") / F.col("max_dcg")).otherwise(F.lit(1.0))
    )
    if weight:
        each = each.join(df.groupBy(group).agg(F.avg(weight).alias("__w")), group)
        value = F.sum(F.col("ndcg") * F.col("__w")) / F.sum("__w")
    else:
        value = F.avg("ndcg")
    return each.agg(value.alias("value")).select(F.lit(f"ndcg@{k}").alias("metric"), "value")


def map_at(df: DataFrame, k: int, group: str = "group_id", tie: str = "row_id", weight: str | None = None) -> DataFrame:
    """Mean over groups of average precision in the first k; divided by min(relevant, k).

    A group without relevant rows counts as 1. `weight` is a group weight: the mean of its rows'.
    """
    of_group = F.avg(weight) if weight else F.lit(1.0)
    relevant = df.groupBy(group).agg(F.count_if(F.col("label") > 0).alias("relevant"), of_group.alias("__w"))
    order = [F.col("score").desc(), F.col(tie)]
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    top = df.select(group, tie, "label", "score").withColumn("__r", rank).where(F.col("__r") <= k)
    upto = W.partitionBy(group).orderBy("__r").rowsBetween(W.unboundedPreceding, 0)  # at most k rows
    hits = top.withColumn("__hits", F.sum((F.col("label") > 0).cast("int")).over(upto))
    got = hits.groupBy(group).agg(
        F.sum(F.when(F.col("label") > 0, F.col("__hits") / F.col("__r")).otherwise(0.0)).alias("precision")
    )
    each = relevant.join(got, group, "left").select(
        F.when(F.col("relevant") > 0, F.coalesce("precision", F.lit(0.0)) / F.least("relevant", F.lit(k)))
        .otherwise(F.lit(1.0))
        .alias("ap"),
        "__w",
    )
    return each.agg((F.sum(F.col("ap") * F.col("__w")) / F.sum("__w")).alias("value")).select(F.lit(f"map@{k}").alias("metric"), "value")


@dataclass(frozen=True)
class CustomMetric:
    """A metric of the caller's: an aggregate over label, prediction, raw and any other column."""

    name: str
    value: Callable[[], Column]
    larger_is_better: bool = False


def metric_name(metric: str | CustomMetric) -> str:
    return metric if isinstance(metric, str) else metric.name


def evaluate(df: DataFrame, metric: str | CustomMetric, **params) -> DataFrame:
    """A metric by name, or the caller's own; `ndcg@5`, `map@3`, `multi_error@2` take their k from the name."""
    if isinstance(metric, CustomMetric):
        return df.agg(metric.value().cast("double").alias("value")).select(F.lit(metric.name).alias("metric"), "value")
    base, _, k = metric.partition("@")
    if base in pointwise_losses():
        return pointwise(df, base, **params)
    table = {
        "auc": auc, "average_precision": average_precision, "auc_mu": auc_mu, "multi_logloss": multi_logloss,
        "cross_entropy_lambda": cross_entropy_lambda,
    }
    if base in table:
        return table[base](df, **params)
    sized = {"ndcg": ndcg, "map": map_at, "multi_error": multi_error}
    return sized[base](df, k=int(k or (1 if base == "multi_error" else 5)), **params)


def eval_all(
    datasets: dict[str, DataFrame], metrics: list[str | CustomMetric], params: dict[str, dict] | None = None, weight: str | None = None
) -> DataFrame:
    """(dataset, metric, value) for every metric on every dataset.

    Pointwise metrics of one dataset share a single pass over it. `weight` names the row
    weights of all datasets.
    """
    params = params or {}
    known = pointwise_losses()
    frames = []
    for name, df in datasets.items():
        shared = [m for m in metrics if isinstance(m, str) and m in known]
        if shared:
            y, p = F.col("label").cast("double"), F.col("prediction")
            values = []
            for m in shared:
                loss = pointwise_losses(**params.get(m, {}))[m](y, p)
                w = F.col(weight) if weight else F.lit(1.0)
                mean = F.sum(w * loss) / F.sum(w)
                value = F.sqrt(mean) if m == "rmse" else mean
                values.append(F.struct(F.lit(m).alias("metric"), value.alias("value")))
            frames.append(df.agg(F.array(*values).alias("m")).select(F.lit(name).alias("dataset"), F.inline("m")))
        for m in metrics:
            if m not in shared:
                frames.append(evaluate(df, m, **({} if isinstance(m, CustomMetric) else {"weight": weight} | params.get(m, {}))).select(F.lit(name).alias("dataset"), "metric", "value"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
