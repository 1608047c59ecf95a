"""Trees and models: a small driver-side form and the tables they are stored as.

`model_nodes` has one row per inner node and `model_leaves` one per leaf; both are bounded
by trees x leaves. A child is a node id, or -1 - leaf id.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.numeric import snap_zero


@dataclass
class Node:
    feature: str
    threshold: float = 0.0
    bin: int = 0
    kind: str = "numeric"
    cats: list[int] = field(default_factory=list)
    cat_bins: list[int] = field(default_factory=list)
    missing_type: str = "none"
    missing_bin: int = -1
    default_left: bool = True
    left: int = 0
    right: int = 0
    gain: float = 0.0
    value: float = 0.0
    weight: float = 0.0
    count: int = 0


@dataclass
class Leaf:
    value: float = 0.0
    weight: float = 0.0
    count: int = 0
    depth: int = 0
    const: float | None = None
    coeffs: dict[str, float] = field(default_factory=dict)


@dataclass
class Tree:
    nodes: list[Node]
    leaves: list[Leaf]
    iteration: int = 0
    class_id: int = 0

    def scaled(self, rate: float) -> Tree:
        return self._mapped(lambda v: v * rate, rate)

    def shifted(self, bias: float) -> Tree:
        return self._mapped(lambda v: v + bias, 1.0)

    def _mapped(self, change, coefficient: float) -> Tree:
        snap = lambda v: 0.0 if abs(v) <= 1e-35 else v
        nodes = [Node(**{**asdict(n), "value": snap(change(n.value))}) for n in self.nodes]
        leaves = [
            Leaf(
                snap(change(x.value)), x.weight, x.count, x.depth,
                None if x.const is None else snap(change(x.const)),
                {f: snap(c * coefficient) for f, c in x.coeffs.items()},
            )
            for x in self.leaves
        ]
        return Tree(nodes, leaves, self.iteration, self.class_id)


@dataclass
class Model:
    trees: list[Tree]
    features: list[str]
    objective: str = "regression"
    num_class: int = 1
    average: bool = False
    params: dict = field(default_factory=dict)

    @property
    def iterations(self) -> int:
        return 1 + max((t.iteration for t in self.trees), default=-1)


NODE_SCHEMA = (
    "tree_id int, iteration int, class_id int, node_id int, feature string, threshold double, bin int, kind string, "
    "cats array<int>, cat_bins array<int>, missing_type string, missing_bin int, default_left boolean, left int, right int, "
    "gain double, value double, weight double, count long"
)
LEAF_SCHEMA = (
    "tree_id int, iteration int, class_id int, leaf_id int, value double, weight double, count long, depth int, "
    "const double, coeffs map<string,double>"
)
META_SCHEMA = "features array<string>, objective string, num_class int, average boolean, params string"


def to_tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, leaves = [], []
    for i, t in enumerate(model.trees):
        head = (i, t.iteration, t.class_id)
        for j, n in enumerate(t.nodes):
            nodes.append(
                (*head, j, n.feature, float(n.threshold), n.bin, n.kind, n.cats, n.cat_bins, n.missing_type, n.missing_bin,
                 n.default_left, n.left, n.right, float(n.gain), float(n.value), float(n.weight), int(n.count))
            )
        for j, x in enumerate(t.leaves):
            leaves.append((*head, j, float(x.value), float(x.weight), int(x.count), x.depth, x.const, x.coeffs or {}))
    meta = [(model.features, model.objective, model.num_class, model.average, json.dumps(model.params))]
    return (
        spark.createDataFrame(nodes, NODE_SCHEMA),
        spark.createDataFrame(leaves, LEAF_SCHEMA),
        spark.createDataFrame(meta, META_SCHEMA),
    )


def from_tables(nodes: DataFrame, leaves: DataFrame, meta: DataFrame) -> Model:
    """Model tables to the driver: bounded by trees x leaves, whatever the data size."""
    m = meta.first()
    trees: dict[int, Tree] = {}
    for r in leaves.orderBy("tree_id", "leaf_id").collect():
        t = trees.setdefault(r["tree_id"], Tree([], [], r["iteration"], r["class_id"]))
        t.leaves.append(Leaf(r["value"], r["weight"], r["count"], r["depth"], r["const"], dict(r["coeffs"] or {})))
    for r in nodes.orderBy("tree_id", "node_id").collect():
        trees[r["tree_id"]].nodes.append(
            Node(r["feature"], r["threshold"], r["bin"], r["kind"], list(r["cats"] or []), list(r["cat_bins"] or []),
                 r["missing_type"], r["missing_bin"], r["default_left"], r["left"], r["right"], r["gain"], r["value"],
                 r["weight"], r["count"])
        )
    ordered = [trees[k] for k in sorted(trees)]
    return Model(ordered, list(m["features"]), m["objective"], m["num_class"], m["average"], json.loads(m["params"] or "{}"))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    for name, frame in zip(("nodes", "leaves", "meta"), to_tables(spark, model)):
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/model_{name}")


def load_model(spark: SparkSession, path: str) -> Model:
    return from_tables(*[spark.read.parquet(f"{path}/model_{n}") for n in ("nodes", "leaves", "meta")])


def dump_model(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree_id, json): one JSON text per tree, bounded by its leaf count."""
    n = nodes.groupBy("tree_id").agg(
        F.sort_array(F.collect_list(F.struct("node_id", "feature", "threshold", "kind", "cats", "default_left", "left", "right", "gain", "value", "count"))).alias("nodes")
    )
    x = leaves.groupBy("tree_id").agg(
        F.sort_array(F.collect_list(F.struct("leaf_id", "value", "weight", "count"))).alias("leaves")
    )
    return x.join(n, "tree_id", "left").select("tree_id", F.to_json(F.struct("tree_id", "nodes", "leaves")).alias("json"))


def merge_models(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append another model's nodes or leaves; its trees are numbered on from the first's."""
    ends = first.agg(
        (F.coalesce(F.max("tree_id"), F.lit(-1)) + 1).alias("t"), (F.coalesce(F.max("iteration"), F.lit(-1)) + 1).alias("i")
    )
    last = F.broadcast(ends)  # one row
    moved = second.join(last, F.lit(True)).withColumn("tree_id", F.col("tree_id") + F.col("t")).withColumn(
        "iteration", F.col("iteration") + F.col("i")
    ).drop("t", "i")
    return first.unionByName(moved.select(*first.columns))


def slice_model(table: DataFrame, start: int, count: int = 0) -> DataFrame:
    """Nodes or leaves of iterations [start, start + count); count <= 0 means all from start."""
    out = table.where(F.col("iteration") >= start)
    return out.where(F.col("iteration") < start + count) if count > 0 else out


def sliced(model: Model, start: int = 0, count: int = 0) -> Model:
    end = start + count if count > 0 else model.iterations
    kept = [t for t in model.trees if start <= t.iteration < end]
    return Model(kept, model.features, model.objective, model.num_class, model.average, model.params)


def rollback_one(model: Model) -> Model:
    return sliced(model, 0, max(model.iterations - 1, 0)) if model.iterations > 1 else Model(
        [], model.features, model.objective, model.num_class, model.average, model.params
    )


def feature_importance(nodes: DataFrame, iterations: int = 0) -> DataFrame:
    """(feature, splits, total_gain) up to an iteration; only splits with a gain count."""
    used = slice_model(nodes, 0, iterations).where(F.col("gain") > 0)
    return used.groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("total_gain"))


def model_bounds(leaves: DataFrame) -> DataFrame:
    """One row: sum over trees of the largest and of the smallest leaf value."""
    each = leaves.groupBy("tree_id").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return each.agg(F.sum("hi").alias("upper_bound"), F.sum("lo").alias("lower_bound"))


def expected_value(leaves: DataFrame) -> DataFrame:
    """(tree_id, expected): count-weighted mean leaf value."""
    mean = F.sum(F.col("value") * F.col("count")) / F.sum("count")
    return leaves.groupBy("tree_id").agg(mean.alias("expected"))


def shrink_trees(table: DataFrame, rate: float) -> DataFrame:
    """Leaf or inner values times `rate`; tiny results become zero."""
    return table.withColumn("value", snap_zero(F.col("value") * rate))


def add_bias(table: DataFrame, bias: float) -> DataFrame:
    return table.withColumn("value", snap_zero(F.col("value") + bias))


def refit_leaves(leaves: DataFrame, fresh: DataFrame, decay: float = 0.9) -> DataFrame:
    """Leaf values blended with those of new data (tree_id, leaf_id, new_value).

    A leaf that no new row reached keeps its value.
    """
    blended = decay * F.col("value") + (1.0 - decay) * F.col("new_value")
    return leaves.join(fresh, ["tree_id", "leaf_id"], "left").withColumn(
        "value", F.coalesce(blended, F.col("value"))
    ).drop("new_value")


