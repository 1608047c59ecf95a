"""Gradients, hessians, starting scores and output transforms of the objectives.

`d` is score minus label. Formulas follow the literature: Friedman 2001 for the losses,
Chen & Guestrin 2016 for the second-order form, Burges 2010 for the ranking one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.numeric import sigmoid, sign, softmax, softplus
from paddock.operators.joins import HOT_ROWS, skewed_join
from paddock.operators.metrics import label_gain
from paddock.operators.prefix import sorted_slices, weighted_percentile
from paddock.operators.ranking import Settings, pair_gradients

GradHess = tuple[Column, Column]


@dataclass(frozen=True)
class ObjectiveParams:
    """Settings of the objectives. Defaults are fixed values."""

    alpha: float = 0.9
    fair_c: float = 1.0
    poisson_max_delta_step: float = 0.7
    tweedie_variance_power: float = 1.5
    sigmoid: float = 1.0
    scale_pos_weight: float = 1.0
    is_unbalance: bool = False
    reg_sqrt: bool = False
    num_class: int = 1
    truncation_level: int = 30
    lambdarank_norm: bool = True
    label_gain: tuple[float, ...] | None = None
    position_bias_regularization: float = 0.0
    objective_seed: int = 5
    custom: Callable[[Column, Column], GradHess] | None = field(default=None, compare=False)


# Objectives whose leaves are renewed to a residual percentile.
RENEWED = ("regression_l1", "quantile", "mape")
RANKING = ("lambdarank", "rank_xendcg")
MULTI = ("multiclass", "multiclassova")
LOG_SCORE = ("poisson", "gamma", "tweedie")


def target(y: Column, p: ObjectiveParams) -> Column:
    """The label a regression fits: its signed square root in square-root mode."""
    return sign(y) * F.sqrt(F.abs(y)) if p.reg_sqrt else y


def _binary(y: Column, s: Column, p: ObjectiveParams) -> GradHess:
    q = sigmoid(s, p.sigmoid)
    w = F.when(y > 0, F.lit(p.scale_pos_weight)).otherwise(F.lit(1.0))
    hot = (y > 0).cast("double")
    return w * p.sigmoid * (q - hot), w * p.sigmoid * p.sigmoid * q * (1.0 - q)


def row_gradients(
    objective: str, label: Column, score: Column, p: ObjectiveParams = ObjectiveParams(), weight: Column | None = None
) -> GradHess:
    """(g, h) of a row-wise objective; `weight` multiplies both, except inside cross_entropy_lambda."""
    y, s = label.cast("double"), score
    one = F.lit(1.0)
    if objective == "regression":
        g, h = s - target(y, p), one
    elif objective == "regression_l1":
        g, h = sign(s - y), one
    elif objective == "huber":
        g, h = F.greatest(F.least(s - y, F.lit(p.alpha)), F.lit(-p.alpha)), one
    elif objective == "fair":
        d, c = s - y, p.fair_c
        g, h = c * d / (F.abs(d) + c), c * c / ((F.abs(d) + c) * (F.abs(d) + c))
    elif objective == "poisson":
        g, h = F.exp(s) - y, F.exp(s + p.poisson_max_delta_step)
    elif objective == "quantile":
        g, h = F.when(s - y >= 0, F.lit(1.0 - p.alpha)).otherwise(F.lit(-p.alpha)), one
    elif objective == "mape":
        scale = 1.0 / F.greatest(one, F.abs(y))
        g, h = sign(s - y) * scale, scale
    elif objective == "gamma":
        g, h = 1.0 - y * F.exp(-s), y * F.exp(-s)
    elif objective == "tweedie":
        rho = p.tweedie_variance_power
        low, high = F.exp((1.0 - rho) * s), F.exp((2.0 - rho) * s)
        g, h = -y * low + high, -y * (1.0 - rho) * low + (2.0 - rho) * high
    elif objective == "binary":
        g, h = _binary(y, s, p)
    elif objective == "cross_entropy":
        q = sigmoid(s)
        g, h = q - y, q * (1.0 - q)
    elif objective == "cross_entropy_lambda":
        w = one if weight is None else weight
        q = sigmoid(s)
        z = 1.0 - F.exp(-w * softplus(s))
        g = w * q * (z - y) / z
        h = w * q * (1.0 - q) * (1.0 - y / z) + y * w * w * q * q * (1.0 - z) / (z * z)
        return g, h
    elif objective == "custom":
        g, h = p.custom(s, y)
    else:
        raise ValueError(f"unknown row-wise objective {objective}")
    return (g, h) if weight is None else (g * weight, h * weight)


def class_gradients(
    objective: str, label: Column, scores: Column, k: int, p: ObjectiveParams, weight: Column | None = None
) -> GradHess:
    """(g, h) of class `k` from an array of raw scores, one per class."""
    hot = (label.cast("int") == k).cast("double")
    if objective == "multiclass":
        q = softmax(scores)[k]
        g, h = q - hot, 2.0 * q * (1.0 - q)
    else:
        g, h = _binary(hot, scores[k], p)
    return (g, h) if weight is None else (g * weight, h * weight)


# Objectives whose gradients `array_gradients` gives too.
IN_ARRAYS = ("regression", "binary", "cross_entropy", "multiclass", "multiclassova")


def array_gradients(objective: str, y: np.ndarray, scores: np.ndarray, p: ObjectiveParams, weight: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(g, h) of each class by the formulas of `row_gradients` and `class_gradients`; scores are rows by classes."""

    def binary(y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = 1.0 / (1.0 + np.exp(-p.sigmoid * s))
        w = np.where(y > 0, p.scale_pos_weight, 1.0)
        return w * p.sigmoid * (q - (y > 0)), w * p.sigmoid * p.sigmoid * q * (1.0 - q)

    s = scores[:, 0]
    if objective == "regression":
        fitted = np.sign(y) * np.sqrt(np.abs(y)) if p.reg_sqrt else y
        got = [(s - fitted, np.ones(len(y)))]
    elif objective == "binary":
        got = [binary(y, s)]
    elif objective == "cross_entropy":
        q = 1.0 / (1.0 + np.exp(-s))
        got = [(q - y, q * (1.0 - q))]
    elif objective == "multiclass":
        grown = np.exp(scores - scores.max(axis=1, keepdims=True))
        q = grown / grown.sum(axis=1, keepdims=True)
        got = [(q[:, k] - (np.trunc(y) == k), 2.0 * q[:, k] * (1.0 - q[:, k])) for k in range(p.num_class)]
    else:
        got = [binary((np.trunc(y) == k).astype(float), scores[:, k]) for k in range(p.num_class)]
    return got if weight is None else [(g * weight, h * weight) for g, h in got]


def gradients(
    df: DataFrame, objective: str, p: ObjectiveParams = ObjectiveParams(), label: str = "label", score: str = "score",
    weight: str | None = None,
) -> DataFrame:
    """Add columns g and h; ranking objectives need group_id and row_id columns."""
    if objective == "lambdarank":
        return _weighted_rows(lambdarank_gradients(df, p, label, score), weight)
    if objective == "rank_xendcg":
        return _weighted_rows(xendcg_gradients(df, p, label, score), weight)
    if objective in MULTI:
        both = [class_gradients(objective, F.col(label), F.col(score), k, p, F.col(weight) if weight else None) for k in range(p.num_class)]
        return df.withColumn("g", F.array(*[g for g, _ in both])).withColumn("h", F.array(*[h for _, h in both]))
    g, h = row_gradients(objective, F.col(label), F.col(score), p, F.col(weight) if weight else None)
    return df.withColumn("g", g).withColumn("h", h)


def _weighted_rows(df: DataFrame, weight: str | None) -> DataFrame:
    return df if weight is None else df.withColumn("g", F.col("g") * F.col(weight)).withColumn("h", F.col("h") * F.col(weight))


def lambdarank_gradients(
    df: DataFrame, p: ObjectiveParams = ObjectiveParams(), label: str = "label", score: str = "score",
    group: str = "group_id", row_id: str = "row_id",
) -> DataFrame:
    """Pairwise ranking gradients, without making pairs of rows.

    Only pairs with one row among the first `truncation_level` of its group count. Rows are put in order of group,
    score and id; each meets its group's first rows in arrays, and what the first rows gain from all
    others is summed there (`ranking`). Work is rows x truncation level for groups of any size.
    """
    key, kind = F.col(group), df.schema[group].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "string"):  # equal keys must be equal in Python too
        key = F.hex(key) if kind == "binary" else (key + 0.0 if kind in ("float", "double") else key).cast("string")
    base = df.select(
        key.alias("key"), row_id, F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"),
        label_gain(F.col(label), list(p.label_gain) if p.label_gain else None).alias("gain"),
    )
    sliced = sorted_slices(base, ["key"], [F.col("s").desc(), F.col(row_id)])
    settings = Settings(p.truncation_level, p.sigmoid, p.lambdarank_norm)
    return df.join(pair_gradients(sliced, row_id, settings), row_id)


def xendcg_gradients(
    df: DataFrame, p: ObjectiveParams = ObjectiveParams(), label: str = "label", score: str = "score",
    group: str = "group_id", row_id: str = "row_id", round_no: int = 0, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Listwise cross entropy against 2^label minus a seeded uniform, per group."""
    noise = hash_unit(F.col(row_id), p.objective_seed, round_no)
    phi = F.pow(F.lit(2.0), F.col(label).cast("double")) - noise
    rows = df.withColumn("__phi", phi)
    tops = rows.groupBy(group).agg(F.max(score).alias("__top"), F.sum("__phi").alias("__phi_sum"))
    joined = skewed_join(rows, tops, [group], "inner", hot_rows).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    sums = joined.groupBy(group).agg(F.sum("__e").alias("__e_sum"))
    q = F.col("__e") / F.col("__e_sum")
    out = skewed_join(joined, sums, [group], "inner", hot_rows)
    return out.withColumn("g", q - F.col("__phi") / F.col("__phi_sum")).withColumn("h", q * (1.0 - q)).drop(
        "__phi", "__phi_sum", "__top", "__e", "__e_sum"
    )


def hash_unit(key: Column, seed: int, step: int = 0) -> Column:
    """A repeatable number in [0, 1) for a row: the same on every read of the table."""
    mixed = F.xxhash64(key.cast("string"), F.lit(seed), F.lit(step))
    return F.pmod(mixed, F.lit(1 << 40)).cast("double") / float(1 << 40)


def start_score(
    df: DataFrame, objective: str, p: ObjectiveParams = ObjectiveParams(), label: str = "label", weight: str | None = None
) -> DataFrame:
    """One row with the starting score; the weighted label mean drives most objectives."""
    y = target(F.col(label).cast("double"), p)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if objective in RENEWED:
        if objective == "mape":
            w = w / F.greatest(F.lit(1.0), F.abs(F.col(label).cast("double")))
        share = p.alpha if objective == "quantile" else 0.5
        return weighted_percentile(df.select(y.alias("value"), w.alias("weight")), share).select(F.col("value").alias("start"))
    mean = F.sum(w * y) / F.sum(w)
    if objective in ("regression", "huber"):
        return df.agg(mean.alias("start"))
    if objective in LOG_SCORE:
        return df.agg(F.log(mean).alias("start"))
    if objective == "binary":
        share = F.sum(w * (y > 0).cast("double")) / F.sum(w)
        share = F.least(F.greatest(share, F.lit(1e-15)), F.lit(1.0 - 1e-15))
        return df.agg((F.log(share / (1.0 - share)) / p.sigmoid).alias("start"))
    if objective == "cross_entropy":
        share = F.least(F.greatest(mean, F.lit(1e-15)), F.lit(1.0 - 1e-15))
        return df.agg(F.log(share / (1.0 - share)).alias("start"))
    if objective == "cross_entropy_lambda":
        # softplus(start) = mean label intensity
        return df.agg(F.log(F.expm1(F.greatest(mean, F.lit(1e-15)))).alias("start"))
    return df.agg((F.count(F.lit(1)) * 0.0).alias("start"))


def class_start_scores(df: DataFrame, objective: str, p: ObjectiveParams, label: str = "label", weight: str | None = None) -> DataFrame:
    """(class_id, start) from class shares: log prior, or its logit in one-versus-all mode."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    shares = [F.sum(w * (F.col(label).cast("int") == k).cast("double")) / F.sum(w) for k in range(p.num_class)]
    safe = [F.least(F.greatest(s, F.lit(1e-15)), F.lit(1.0 - 1e-15)) for s in shares]
    start = [F.log(s) if objective == "multiclass" else F.log(s / (1.0 - s)) / p.sigmoid for s in safe]
    return df.agg(F.array(*start).alias("starts")).select(F.posexplode("starts").alias("class_id", "start"))


def output(objective: str, raw: Column, p: ObjectiveParams = ObjectiveParams()) -> Column:
    """Raw score to prediction."""
    if objective in LOG_SCORE:
        return F.exp(raw)
    if objective == "binary":
        return sigmoid(raw, p.sigmoid)
    if objective == "cross_entropy":
        return sigmoid(raw)
    if objective == "cross_entropy_lambda":
        return softplus(raw)
    if objective == "multiclass":
        return softmax(raw)
    if objective == "multiclassova":
        return F.transform(raw, lambda s: sigmoid(s, p.sigmoid))
    if objective == "regression" and p.reg_sqrt:
        return sign(raw) * raw * raw
    return raw


