"""Feature contributions (Shapley values of trees, Lundberg et al. 2018).

Worked out path by path: for each leaf, the features on its path either let a row through
or not, and a path with d distinct features gives each of them a share that depends only on
those d indicator bits and the cover ratios. Rows are processed as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.numeric import ZERO_LIMIT
from paddock.operators.model import Model, Node, Tree


def _left(n: Node, v: np.ndarray) -> np.ndarray:
    if n.kind == "categorical":
        return np.isin(np.trunc(v), n.cats) & (v > -1)
    if n.missing_type == "nan":
        return np.where(np.isnan(v), n.default_left, v <= n.threshold)
    v = np.where(np.isnan(v), 0.0, v)
    if n.missing_type == "zero":
        return np.where(np.abs(v) <= ZERO_LIMIT, n.default_left, v <= n.threshold)
    return v <= n.threshold


def _count(tree: Tree, child: int) -> float:
    return tree.leaves[-1 - child].count if child < 0 else tree.nodes[child].count


def leaf_paths(tree: Tree) -> list[tuple[int, list[tuple[int, bool, float]]]]:
    """(leaf, [(node, went left, share of the node's rows that went this way)]) per leaf."""
    found: list[tuple[int, list[tuple[int, bool, float]]]] = []

    def walk(child: int, path: list[tuple[int, bool, float]]) -> None:
        if child < 0:
            found.append((-1 - child, path))
            return
        n = tree.nodes[child]
        for went_left, following in ((True, n.left), (False, n.right)):
            walk(following, [*path, (child, went_left, _count(tree, following) / n.count if n.count else 0.5)])

    walk(0 if tree.nodes else -1, [])
    return found


def _shares(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Shapley share of each of d path features, rows x d, of a game that pays the product
    over features of their indicator (in the coalition) or their cover ratio (out of it)."""
    rows, d = ones.shape
    result = np.zeros((rows, d))
    weight = np.array([1.0 / (d * _binomial(d - 1, k)) for k in range(d)])
    for i in range(d):
        # Coefficients by coalition size of the product over the other features.
        sizes = np.zeros((rows, d))
        sizes[:, 0] = 1.0
        for j in range(d):
            if j != i:
                grown = sizes * zeros[j]
                grown[:, 1:] += sizes[:, :-1] * ones[:, j : j + 1]
                sizes = grown
        result[:, i] = (sizes @ weight) * (ones[:, i] - zeros[i])
    return result


def _binomial(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def contributions(tree: Tree, x: np.ndarray, at: dict[str, int]) -> np.ndarray:
    """Rows x (features + 1): shares of one tree's value, the last column its expected value."""
    out = np.zeros((len(x), len(at) + 1))
    total = sum(leaf.count for leaf in tree.leaves)
    out[:, -1] = sum(leaf.value * leaf.count for leaf in tree.leaves) / total if total else 0.0
    tests = [_left(n, x[:, at[n.feature]]) for n in tree.nodes]
    for leaf, path in leaf_paths(tree):
        ones: dict[int, np.ndarray] = {}
        zeros: dict[int, float] = {}
        for node, went_left, ratio in path:
            f = at[tree.nodes[node].feature]
            through = tests[node] if went_left else ~tests[node]
            ones[f] = ones.get(f, np.ones(len(x), bool)) & through
            zeros[f] = zeros.get(f, 1.0) * ratio
        if ones:
            shares = _shares(np.column_stack([ones[f] for f in ones]).astype(float), np.array([zeros[f] for f in ones]))
            for k, f in enumerate(ones):
                out[:, f] += shares[:, k] * tree.leaves[leaf].value
    return out


def predict_contrib(df: DataFrame, model: Model, keep: list[str], name: str = "contrib") -> DataFrame:
    """(keep, contrib): per class, one value per feature and then the expected value.

    Models with linear leaves are refused: their contributions would not add up to the score.
    """
    if any(x.const is not None and x.coeffs for t in model.trees for x in t.leaves):
        raise ValueError("contributions are defined for constant leaves only")
    at = {f: i for i, f in enumerate(model.features)}
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by trees x leaves
    width = len(at) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            x = frame[m.features].to_numpy(dtype=float, na_value=np.nan)
            out = np.zeros((len(x), width * m.num_class))
            for t in m.trees:
                out[:, t.class_id * width : (t.class_id + 1) * width] += contributions(t, x, at)
            if m.average:
                out /= max(len(m.trees) // m.num_class, 1)
            result = frame[keep].copy()
            result[name] = list(out)
            yield result

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    narrow = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in model.features if f not in keep])
    return narrow.mapInPandas(run, f"{schema}, {name} array<double>")


def predict_sparse(contrib: DataFrame, keep: list[str], name: str = "contrib") -> DataFrame:
    """(keep, feature, value) of the non-zero contributions."""
    long = contrib.select(*keep, F.posexplode(name).alias("feature", "value"))
    return long.where(F.col("value") != 0.0)
