"""Scoring: small models as generated CASE expressions, others walked batch by batch.

Neither shuffles nor joins, and both give the same numbers. A whole model as one expression
outgrows generated code after a few trees, so `expression_nodes` of `predict_raw` (a few trees
by default) says up to which size it is used; beyond it an Arrow-batched function, built once
per task, walks the trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.numeric import ZERO_LIMIT
from paddock.operators.binning import FeatureBins
from paddock.operators.model import Model, Node, Tree
from paddock.operators.objectives import ObjectiveParams, output

# Inner nodes per model up to which expressions are generated.
EXPRESSION_NODES = 200


def _name(feature: str, quote: str = "`") -> str:
    return f"{quote}{feature}{quote}"


def _num(x: float) -> str:
    if x == float("inf"):
        return "CAST('Infinity' AS DOUBLE)"
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def _goes_left(n: Node, quote: str) -> str:
    x = _name(n.feature, quote)
    if n.kind == "categorical":
        inside = ", ".join(str(c) for c in sorted(n.cats)) or "-1"
        whole = f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS BIGINT)"
        return f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) > 2e9 THEN FALSE ELSE {whole} IN ({inside}) END"
    side = "TRUE" if n.default_left else "FALSE"
    lost = f"({x} IS NULL OR isnan({x}))"
    if n.missing_type == "nan":
        return f"CASE WHEN {lost} THEN {side} ELSE {x} <= {_num(n.threshold)} END"
    if n.missing_type == "zero":
        return f"CASE WHEN {lost} OR abs({x}) <= {ZERO_LIMIT!r} THEN {side} ELSE {x} <= {_num(n.threshold)} END"
    return f"CASE WHEN {lost} THEN {'TRUE' if n.threshold >= 0 else 'FALSE'} ELSE {x} <= {_num(n.threshold)} END"


def bin_reads(specs: list[FeatureBins]) -> dict[str, str]:
    """SQL of each feature's bin in a binned row."""
    return {s.name: f"coalesce(try_element_at(bins, {i}), {s.default_bin})" if s.sparse else f"bins[{i}]" for i, s in enumerate(specs)}


def _binned_left(n: Node, reads: dict[str, str]) -> str:
    b = reads[n.feature]
    if n.kind == "categorical":
        return f"{b} IN ({', '.join(str(c) for c in n.cat_bins) or '-1'})"
    side = "TRUE" if n.default_left else "FALSE"
    if n.missing_bin < 0:
        return f"{b} <= {n.bin}"
    return f"IF({b} = {n.missing_bin}, {side}, {b} <= {n.bin})"


def _case(tree: Tree, test, leaf) -> str:
    def at(child: int) -> str:
        if child < 0:
            return leaf(-1 - child)
        n = tree.nodes[child]
        return f"CASE WHEN {test(n)} THEN {at(n.left)} ELSE {at(n.right)} END"

    return at(0) if tree.nodes else leaf(0)


def leaf_sql(tree: Tree, quote: str = "`") -> str:
    """SQL text giving the leaf a row falls into."""
    return _case(tree, lambda n: _goes_left(n, quote), str)


def value_sql(tree: Tree, quote: str = "`") -> str:
    """SQL text giving the tree's value for a row, linear leaves included."""

    def leaf(i: int) -> str:
        x = tree.leaves[i]
        if x.const is None:
            return _num(x.value)
        terms = " + ".join([_num(x.const), *[f"{_num(c)} * {_name(f, quote)}" for f, c in x.coeffs.items()]])
        if not x.coeffs:
            return terms
        lost = " OR ".join(f"{_name(f, quote)} IS NULL OR isnan({_name(f, quote)})" for f in x.coeffs)
        return f"CASE WHEN {lost} THEN {_num(x.value)} ELSE {terms} END"

    return _case(tree, lambda n: _goes_left(n, quote), leaf)


def binned_leaf(tree: Tree, specs: list[FeatureBins]) -> Column:
    """Leaf of a binned row (column `bins`)."""
    reads = bin_reads(specs)
    return F.expr(_case(tree, lambda n: _binned_left(n, reads), str))


def model_to_sql(model: Model, class_id: int = 0, quote: str = "`") -> str:
    """The model's raw score as one SQL expression, usable in `selectExpr` and elsewhere."""
    trees = [t for t in model.trees if t.class_id == class_id]
    total = " + ".join(value_sql(t, quote) for t in trees) or "0e0"
    return f"({total}) / {len(trees)}e0" if model.average and trees else f"({total})"


class _Walker:
    """Leaf numbers and values of feature rows, one numpy step per level of a tree."""

    def __init__(self, model: Model):
        self.model = model
        at = {f: i for i, f in enumerate(model.features)}
        self.at, self.packed = at, []
        for t in model.trees:
            self.packed.append(
                dict(
                    feature=np.array([at[n.feature] for n in t.nodes], int), threshold=np.array([n.threshold for n in t.nodes]),
                    left=np.array([n.left for n in t.nodes], int), right=np.array([n.right for n in t.nodes], int),
                    missing=np.array([{"none": 0, "zero": 1, "nan": 2}[n.missing_type] for n in t.nodes], int),
                    default=np.array([n.default_left for n in t.nodes], bool),
                    cats=[np.array(n.cats, float) if n.kind == "categorical" else None for n in t.nodes],
                    sets=[i for i, n in enumerate(t.nodes) if n.kind == "categorical"], values=np.array([x.value for x in t.leaves]),
                )
            )

    def leaf(self, tree: int, x: np.ndarray) -> np.ndarray:
        p = self.packed[tree]
        place = np.zeros(len(x), int) if len(p["feature"]) else np.full(len(x), -1)
        while (open_rows := np.flatnonzero(place >= 0)).size:
            node = place[open_rows]
            v = x[open_rows, p["feature"][node]]
            kind = p["missing"][node]
            v = np.where(np.isnan(v) & (kind != 2), 0.0, v)
            lost = ((kind == 1) & (np.abs(v) <= ZERO_LIMIT)) | ((kind == 2) & np.isnan(v))
            left = np.where(lost, p["default"][node], v <= p["threshold"][node])
            for i in p["sets"]:
                mine = node == i
                raw = x[open_rows[mine], p["feature"][i]]
                left[mine] = np.isin(np.trunc(raw), p["cats"][i]) & (raw > -1)
            place[open_rows] = np.where(left, p["left"][node], p["right"][node])
        return -1 - place

    def value(self, tree: int, x: np.ndarray) -> np.ndarray:
        leaf = self.leaf(tree, x)
        value = self.packed[tree]["values"][leaf]
        for i, q in enumerate(self.model.trees[tree].leaves):
            if q.const is not None:
                mine = np.flatnonzero(leaf == i)
                linear = q.const + sum(c * x[mine, self.at[f]] for f, c in q.coeffs.items())
                value[mine] = np.where(np.isnan(linear), q.value, linear)
        return value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.model.num_class))
        for i, t in enumerate(self.model.trees):
            out[:, t.class_id] += self.value(i, x)
        return out / max(len(self.packed) // self.model.num_class, 1) if self.model.average else out

    def stopped(self, x: np.ndarray, freq: int, margin: float) -> np.ndarray:
        """Raw scores; after each block of `freq` rounds, rows with a wide enough margin are let go."""
        out = np.zeros((len(x), self.model.num_class))
        going = np.arange(len(x))
        for start in range(0, self.model.iterations, freq):
            part = x[going]
            for i, t in enumerate(self.model.trees):
                if start <= t.iteration < start + freq:
                    out[going, t.class_id] += self.value(i, part)
            going = going[~(_margin(out[going]) > margin)]
            if not going.size:
                break
        return out


def _margin(scores: np.ndarray) -> np.ndarray:
    """Twice the absolute score of one class, else the lead of the best over the second."""
    if scores.shape[1] == 1:
        return 2.0 * np.abs(scores[:, 0])
    ordered = np.sort(scores, axis=1)
    return ordered[:, -1] - ordered[:, -2]


def _walked(df: DataFrame, model: Model, kind: str, walk: Callable[[_Walker, np.ndarray], np.ndarray]) -> Column:
    """An array column of what `walk` gives for the features of each row, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by trees x leaves

    item = {"int": pa.int32(), "double": pa.float64()}[kind]

    @F.arrow_udf(f"array<{kind}>")
    def batch_by_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        walker = _Walker(shared.value)
        for features in batches:
            got = walk(walker, np.column_stack([f.to_numpy(zero_copy_only=False).astype(float) for f in features.flatten()]))
            ends = np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(got.reshape(-1), item))

    return batch_by_batch(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))


def _is_small(model: Model, expression_nodes: int) -> bool:
    return sum(len(t.nodes) for t in model.trees) <= expression_nodes


def predict_leaf(df: DataFrame, model: Model, name: str = "leaves", expression_nodes: int = EXPRESSION_NODES) -> DataFrame:
    """Add an array with one leaf index per tree."""
    if _is_small(model, expression_nodes):
        return df.withColumn(name, F.array(*[F.expr(leaf_sql(t)).cast("int") for t in model.trees]))

    def leaves(walker: _Walker, x: np.ndarray) -> np.ndarray:
        return np.stack([walker.leaf(i, x) for i in range(len(walker.packed))], axis=1).astype(np.int32)

    return df.withColumn(name, _walked(df, model, "int", leaves))


def predict_raw(df: DataFrame, model: Model, name: str = "raw", expression_nodes: int = EXPRESSION_NODES) -> DataFrame:
    """Add the raw score: a double, or an array with one per class."""
    if _is_small(model, expression_nodes):
        scores = [F.expr(model_to_sql(model, k)).cast("double") for k in range(model.num_class)]
        return df.withColumn(name, scores[0] if model.num_class == 1 else F.array(*scores))
    packed = _walked(df, model, "double", lambda walker, x: walker.raw(x))
    return df.withColumn(name, packed[0] if model.num_class == 1 else packed)


def predict(df: DataFrame, model: Model, name: str = "prediction", params: ObjectiveParams | None = None) -> DataFrame:
    """Add the transformed output."""
    p = params or ObjectiveParams(**{k: v for k, v in model.params.get("objective_params", {}).items()})
    scored = predict_raw(df, model, "__raw")
    return scored.withColumn(name, output(model.objective, F.col("__raw"), p)).drop("__raw")


def predict_early_stop(
    df: DataFrame, model: Model, freq: int = 10, margin: float = 10.0, name: str = "raw", expression_nodes: int = EXPRESSION_NODES
) -> DataFrame:
    """Raw score that stops adding trees, every `freq` iterations, once its margin is reached.

    The margin is twice the absolute score of a single-class model, else the lead of the
    best class over the second. Rows that are done leave the batch, so later trees cost them nothing.
    """
    if model.objective not in ("binary", "multiclass", "multiclassova", "lambdarank", "rank_xendcg", "cross_entropy"):
        return predict_raw(df, model, name, expression_nodes)
    packed = _walked(df, model, "double", lambda walker, x: walker.stopped(x, freq, margin))
    return df.withColumn(name, packed[0] if model.num_class == 1 else packed)


def score_by_leaf(leaf_rows: DataFrame, leaves: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, leaves array) joined to the leaf table and summed per row: the table form of
    scoring. The leaf table is bounded by trees x leaves."""
    long = leaf_rows.select(row_id, F.posexplode("leaves").alias("tree_id", "leaf_id"))
    small = F.broadcast(leaves.select("tree_id", "leaf_id", "value"))
    return long.join(small, ["tree_id", "leaf_id"]).groupBy(row_id).agg(F.sum("value").alias("raw"))


def predict_map(df: DataFrame, model: Model, column: str = "features", name: str = "raw") -> DataFrame:
    """Scores of rows whose features are a map; an absent feature is 0."""
    wide = df.select(
        "*", *[F.coalesce(F.try_element_at(column, F.lit(f)), F.lit(0.0)).alias(f) for f in model.features]
    )
    return predict_raw(wide, model, name).drop(*model.features)


def predict_files(spark, paths: list[str], model: Model, out: str, fmt: str = "parquet") -> None:
    """Read, score, write: the prediction of every row of the files."""
    predict(spark.read.format(fmt).load(paths), model).write.mode("overwrite").format(fmt).save(out)
