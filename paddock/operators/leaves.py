"""Leaf renewal and linear leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.model import Tree
from paddock.operators.prefix import running_totals


def renew_leaf_percentile(rows: DataFrame, alpha: float, leaf: str = "leaf", weighted: bool = False) -> DataFrame:
    """(leaf, renewed) from rows (leaf, residual, weight, row_id): the alpha percentile of the residuals.

    Residuals are taken in descending order; the place (1 - alpha) * n blends its two
    neighbours. Places come from a range-partitioned running total, so a leaf may hold any
    number of rows. In weighted form the place is the first whose weight total passes
    (1 - alpha) of the whole, and the ends of the order take their own value.
    """
    order = [F.col("residual").desc(), F.col("row_id")]
    totals = {"place": F.lit(1).cast("bigint")}
    if weighted:
        totals["reach"] = F.col("weight")
    placed = running_totals(rows, [leaf], order, totals)
    sums = rows.groupBy(leaf).agg(F.count(F.lit(1)).alias("n"), *([F.sum("weight").alias("w")] if weighted else []))
    both = placed.join(F.broadcast(sums), leaf)  # one row per leaf
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("residual")))
    if not weighted:
        spot = (1.0 - alpha) * F.col("n")
        pos = F.floor(spot)
        near = both.where(F.col("place").between(F.greatest(pos, F.lit(1)), F.least(pos + 1, F.col("n"))))
        v1, v2 = at(F.greatest(pos, F.lit(1))), at(F.least(pos + 1, F.col("n")))
        n_ = F.any_value("n")
        spot_, pos_ = (1.0 - alpha) * n_, F.floor((1.0 - alpha) * n_)
        value = F.when((pos_ < 1) | (pos_ >= n_), v1).otherwise(v1 - (v1 - v2) * (spot_ - pos_))
        return near.groupBy(leaf).agg(value.alias("renewed"))
    threshold = (1.0 - alpha) * F.col("w")
    passes = both.where(F.col("reach") > threshold).groupBy(leaf).agg(F.min("place").alias("pos"))
    near = both.join(F.broadcast(passes), leaf).where(F.col("place").between(F.col("pos") - 1, F.col("pos")))
    v1, v2 = at(F.col("pos") - 1), at(F.col("pos"))
    r1 = F.max(F.when(F.col("place") == F.col("pos") - 1, F.col("reach")))
    r2 = F.max(F.when(F.col("place") == F.col("pos"), F.col("reach")))
    edge = (F.any_value("pos") == 1) | (F.any_value("pos") == F.any_value("n"))
    blend = v1 - (v1 - v2) * (F.any_value(threshold) - r1) / (r2 - r1)
    return near.groupBy(leaf).agg(F.when(edge, v2).otherwise(blend).alias("renewed"))


def branch_features(tree: Tree) -> list[list[str]]:
    """Numeric features on the path of each leaf."""
    found: list[list[str]] = [[] for _ in tree.leaves]

    def walk(child: int, path: list[str]) -> None:
        if child < 0:
            found[-1 - child] = sorted(set(path))
            return
        n = tree.nodes[child]
        more = [*path, n.feature] if n.kind == "numeric" else path
        walk(n.left, more)
        walk(n.right, more)

    if tree.nodes:
        walk(0, [])
    return found


def linear_leaves(rows: DataFrame, tree: Tree, leaf: Column, ridge: float) -> None:
    """Fit value = const + sum(coef * feature) in every leaf, in place.

    One grouped aggregate sums the normal equations (raw feature columns, g, h); the systems,
    one per leaf and as wide as its path, are solved on the driver. Rows with a missing path
    feature are left out, and take the plain leaf value when scored.
    """
    import numpy as np

    paths = branch_features(tree)
    width = max((len(f) for f in paths), default=0)
    if width == 0:
        for x in tree.leaves:
            x.const = x.value
        return
    cells = F.lit(None).cast("array<double>")
    for i, names in enumerate(paths):
        own = [F.col(f).cast("double") for f in names] + [F.lit(0.0)] * (width - len(names))
        cells = F.when(F.col("__leaf") == i, F.array(*own)).otherwise(cells)
    x = rows.withColumn("__leaf", leaf).withColumn("__x", F.concat(cells, F.array(F.lit(1.0))))
    x = x.where(~F.exists("__x", lambda v: v.isNull() | F.isnan(v)))
    at = lambda i: F.col("__x")[i]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    sums = x.groupBy("__leaf").agg(
        *[F.sum(at(i) * at(j) * F.col("h")).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(at(i) * F.col("g")).alias(f"b{i}") for i in range(width + 1)],
    )
    for x_leaf in tree.leaves:
        x_leaf.const = x_leaf.value
    for r in sums.collect():  # one row per leaf
        names = paths[r["__leaf"]]
        keep = [*range(len(names)), width]
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in keep] for i in keep])
        b = np.array([r[f"b{i}"] for i in keep])
        a[np.arange(len(names)), np.arange(len(names))] += ridge
        try:
            solved = -np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            continue
        if np.all(np.isfinite(solved)):
            tree.leaves[r["__leaf"]].coeffs = dict(zip(names, map(float, solved[:-1])))
            tree.leaves[r["__leaf"]].const = float(solved[-1])
