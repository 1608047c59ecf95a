"""Boosting rounds as Spark jobs: gbdt, random forest, dart, many classes, early stopping."""

from __future__ import annotations

import math
import random
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.numeric import fixed_point
from paddock.operators import metrics as M
from paddock.operators.binning import FeatureBins, bin_table, collect_spec, make_bins
from paddock.operators.blocks import Grader, Values, array_grader, graded_tops, pack_graded
from paddock.operators.leaves import linear_leaves, renew_leaf_percentile
from paddock.operators.model import Leaf, Model, Tree
from paddock.operators.objectives import (
    IN_ARRAYS, MULTI, RANKING, RENEWED, ObjectiveParams, class_gradients, class_start_scores, hash_unit, lambdarank_gradients, output,
    row_gradients, start_score, xendcg_gradients,
)
from paddock.operators.position_bias import PositionFactors
from paddock.operators.sampling import BIN_SAMPLE, bag_condition, feature_sample, goss_weights, sample_for_bins
from paddock.operators.scoring import binned_leaf, predict_leaf, predict_raw
from paddock.operators.state import PART_ROWS, ROW, BlockRows, RoundBlocks, RoundRows, TwoPartRows
from paddock.operators.trees import TreeParams, plain_output, grow_trees
from paddock.session import cut_lineage, discard, shared_folder


START = "__start"  # scores before any tree, where the scores of a round differ from those stored


@dataclass(frozen=True)
class TrainParams:
    """Settings of a training run. Defaults are fixed values."""

    objective: str = "regression"
    boosting: str = "gbdt"
    num_iterations: int = 100
    learning_rate: float = 0.1
    max_bin: int = 255
    min_data_in_bin: int = 3
    max_bin_by_feature: dict[str, int] = field(default_factory=dict)
    bin_construct_sample_cnt: int | None = BIN_SAMPLE  # None: all rows
    data_random_seed: int = 1
    use_missing: bool = True
    zero_as_missing: bool = False
    boost_from_average: bool = True
    data_sample_strategy: str = "bagging"
    bagging_fraction: float = 1.0
    pos_bagging_fraction: float = 1.0
    neg_bagging_fraction: float = 1.0
    bagging_freq: int = 0
    bagging_seed: int = 3
    bagging_by_query: bool = False
    top_rate: float = 0.2
    other_rate: float = 0.1
    feature_fraction: float = 1.0
    drop_rate: float = 0.1
    max_drop: int = 50
    skip_drop: float = 0.5
    uniform_drop: bool = False
    xgboost_dart_mode: bool = False
    drop_seed: int = 4
    early_stopping_round: int = 0
    early_stopping_min_delta: float = 0.0
    first_metric_only: bool = False
    metric: tuple[str | M.CustomMetric, ...] = ()
    linear_tree: bool = False
    linear_lambda: float = 0.0
    use_quantized_grad: bool = False
    num_grad_quant_bins: int = 4
    quant_train_renew_leaf: bool = False
    stochastic_rounding: bool = True
    store_levels: int = 3  # levels of growth after which the nodes of the rows are stored anew
    part_rows: int = PART_ROWS  # rows of a round from which those under a few nodes are kept apart
    checkpoint_every: int = 10  # of refitting
    trees_together: int = 8
    subtract_rows: int | None = None
    tree: TreeParams = TreeParams()
    objective_params: ObjectiveParams = ObjectiveParams()


@dataclass
class TrainResult:
    model: Model
    history: list[dict[str, float]]
    best_iteration: int
    specs: list[FeatureBins]
    position_factors: DataFrame | None = None  # (position, factor) of a ranker trained with positions


def prepare_bins(df: DataFrame, features: list[str], categorical: list[str], p: TrainParams) -> list[FeatureBins]:
    """Bins from a bounded sample of the rows, on the driver as features x bin limit values."""
    sample = sample_for_bins(df, p.bin_construct_sample_cnt, p.data_random_seed)
    table = make_bins(
        df, [f for f in features if f not in categorical], categorical, sample, p.max_bin, max_bin=p.max_bin,
        min_data_in_bin=p.min_data_in_bin, max_bin_by_feature=p.max_bin_by_feature, use_missing=p.use_missing,
        zero_as_missing=p.zero_as_missing,
    )
    found = {s.name: s for s in collect_spec(table)}
    return [found.get(f, FeatureBins(f, bounds=[float("inf")])) for f in features]


class _Run:
    """One training run: the scored rows and the trees so far."""

    def __init__(self, df, features, p, categorical, specs, init_model, valid):
        self.p, self.features = p, features
        self.objective, self.op = p.objective, p.objective_params
        self.classes = self.op.num_class if p.objective in MULTI else 1
        self.specs = specs or prepare_bins(df, features, list(categorical), p)
        self.trees: list[Tree] = []
        self.used: set[str] = set()
        self.init = init_model
        self.limits: dict | None = None
        self.graded: str | None = None  # folder of a ranking round's graded rows
        if self.op.is_unbalance and p.objective == "binary":
            n = df.agg(F.count_if(F.col("label") > 0).alias("a"), F.count_if(F.col("label") <= 0).alias("b")).first()
            if n["a"]:
                self.op = replace(self.op, scale_pos_weight=n["b"] / n["a"])
        self.starts = self._starts(df)
        self.factors = PositionFactors.zeros(df) if p.objective == "lambdarank" and "position" in df.columns else None
        self.state = self._binned(df, self._rows_alone(df))
        self.valid = {name: self._binned(v) for name, v in (valid or {}).items()}

    def close(self) -> None:
        self._drop_graded()
        for state in (self.state, *self.valid.values()):
            state.close()

    def _starts(self, df: DataFrame) -> list[float]:
        if not self.p.boost_from_average or self.init is not None or self.objective in RANKING or "init_score" in df.columns:
            return [0.0] * self.classes
        weight = "weight" if "weight" in df.columns else None
        if self.objective in MULTI:
            got = class_start_scores(df, self.objective, self.op, weight=weight).orderBy("class_id").collect()
            return [r["start"] for r in got]
        return [start_score(df, self.objective, self.op, weight=weight).first()["start"] or 0.0]

    def _rows_alone(self, df: DataFrame) -> bool:
        """Whether the gradients of a dense row need no other row, so that rows can stay in their blocks."""
        several = self.objective in RANKING or self.p.data_sample_strategy == "goss" or any(s.sparse for s in self.specs)
        given = self.init is None and "init_score" in df.columns and df.schema["init_score"].dataType.typeName() == "array"
        return not (several or given)

    def _binned(self, df: DataFrame, in_blocks: bool = False) -> TwoPartRows | BlockRows:
        """Bins and metadata, written once, and starting scores, the part that is rewritten; in blocks, all are."""
        names = [c for c in ("row_id", "label", "weight", "group_id", "position") if c in df.columns]
        raw = [f for f in self.features if f not in names] if self.p.linear_tree else []
        if self.init is not None:
            df = predict_raw(df, self.init, "__init")
            first = F.col("__init") if self.classes > 1 else F.array("__init")
        elif "init_score" in df.columns:
            scalar = df.schema["init_score"].dataType.simpleString() != "array<double>"
            first = F.array(F.coalesce("init_score", F.lit(0.0))) if scalar else F.col("init_score")
        else:
            first = F.array(*[F.lit(float(s)) for s in self.starts])
        scored = df.withColumn("scores", first)
        if any(s.sparse for s in self.specs):
            binned = scored.select(*names, *raw, "scores", "bins")
        else:
            binned = bin_table(scored, self.specs, [*names, *raw, "scores"], packed=True)
        changing = ["scores"]
        if self._keeps_leaves:
            binned, changing = binned.withColumn("leaves", F.array().cast("array<smallint>")), ["scores", "leaves"]
        wide = any(max(len(s.bounds), len(s.categories)) > 32_000 for s in self.specs)
        if in_blocks:  # only what rounds read is written every round
            read = {"row_id": self.p.bagging_freq > 0 or self.p.use_quantized_grad, "group_id": self.p.bagging_by_query, "position": False}
            unread = [c for c, by_rounds in read.items() if not by_rounds and not (self.p.linear_tree and c in self.features)]
            return BlockRows(binned.drop(*unread), len(self.specs), changing, wide)
        return TwoPartRows(binned, len(self.specs), changing, wide=wide)

    @property
    def _keeps_leaves(self) -> bool:
        return self.p.boosting == "dart"

    def gradients(self, rows: DataFrame, iteration: int) -> DataFrame:
        weight = F.col("weight") if "weight" in rows.columns else None
        score = F.col("scores")
        if self.objective in RANKING:
            flat = rows.withColumn("score", score[0])
            if self.objective == "lambdarank":
                raised = flat if self.factors is None else self.factors.added_to(flat)
                got = lambdarank_gradients(raised, self.op)
            else:
                got = xendcg_gradients(flat, self.op, round_no=iteration)
            scale = F.lit(1.0) if weight is None else weight
            return got.withColumn("g0", F.col("g") * scale).withColumn("h0", F.col("h") * scale)
        for k in range(self.classes):
            if self.objective in MULTI:
                g, h = class_gradients(self.objective, F.col("label"), score, k, self.op, weight)
            else:
                g, h = row_gradients(self.objective, F.col("label"), score[0], self.op, weight)
            rows = rows.withColumn(f"g{k}", g).withColumn(f"h{k}", h)
        return rows

    def sampled(self, rows: DataFrame, iteration: int) -> Column | None:
        p = self.p
        key = "group_id" if p.bagging_by_query else "row_id"
        label = F.col("label") if self.objective == "binary" else None
        return bag_condition(
            F.col(key), iteration, p.bagging_fraction, p.bagging_freq, p.bagging_seed, label, p.pos_bagging_fraction,
            p.neg_bagging_fraction,
        )

    def _goss(self, rows: DataFrame, iteration: int) -> DataFrame:
        """All rows, with `goss_weight` and weighted gradients; both are null for rows left out."""
        size = F.abs(F.col("g0") * F.col("h0"))
        for k in range(1, self.classes):
            size = size + F.abs(F.col(f"g{k}") * F.col(f"h{k}"))
        weighed = goss_weights(rows, iteration, self.p.top_rate, self.p.other_rate, self.p.bagging_seed, size=size)
        for k in range(self.classes):
            weighed = weighed.withColumns({f"{c}{k}": F.col(f"{c}{k}") * F.col("goss_weight") for c in "gh"})
        return weighed

    def _uses_goss(self, iteration: int) -> bool:
        return self.p.data_sample_strategy == "goss" and iteration >= int(1.0 / self.p.learning_rate)

    def _scored(self, weighed: tuple[list[Tree], list[float]] | None, ways: list = (), held: bool = False) -> DataFrame:
        """Rows with the scores of a round, which are those of `weighed` trees if given."""
        if isinstance(self.state, BlockRows):
            return self.state.rows(ways, self._values(weighed), held)
        if weighed is None:
            return self.state.rows
        return weighted_scores(self.state.rows.withColumn(START, F.col("scores")), *weighed, self.classes)

    def _values(self, weighed: tuple[list[Tree], list[float]] | None) -> Values:
        trees, weights = weighed or ([], [])
        return [(t.class_id, [weights[t.iteration] * x.value for x in t.leaves]) for t in trees]

    def _grader(self, bags: list[Column | None]) -> Grader | None:
        """How gradients come from arrays; None where they need Spark's expressions (other objectives, bags, rounding by row)."""
        if not isinstance(self.state, BlockRows) or self.objective not in IN_ARRAYS or self.p.use_quantized_grad:
            return None
        plain = all(f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") for f in self.state.schema if f.name in ("label", "weight"))
        if not plain or len(bags) > 1 or bags[0] is not None:
            return None
        return array_grader(self.objective, replace(self.op, custom=None))

    def build(
        self, iteration: int, bags: list[Column | None] | None = None, weighed: tuple[list[Tree], list[float]] | None = None
    ) -> tuple[list[Tree], RoundRows | RoundBlocks | None, list]:
        """Trees of one round (one per class), or of several forest rounds when `bags` has several.

        With them come the round's rows and the growth of each tree, which know every row's leaf.
        """
        p = self.p
        base = self._scored(weighed)
        graded = self.gradients(base, iteration)
        if self.objective in RANKING:  # read for their limits, then for the round's rows
            graded = self._written(graded)
        bags = bags or [self.sampled(base, iteration)]
        goss_now = self._uses_goss(iteration)
        if goss_now:
            graded = self._goss(graded, iteration)
        n_slots = self.classes * len(bags)
        grader = self._grader(bags)
        values = self._values(weighed)
        tops = self._tops(graded) if grader is None else self._limits(graded) or graded_tops(self.state.blocks, grader, self.classes, values).first().asDict()
        if not tops["n"]:
            return [Tree([], [Leaf()], iteration, k) for k in range(n_slots)], None, []
        scale = self._scales(tops)
        slots, columns = [], []
        for b, bag in enumerate(bags):
            for k in range(self.classes):
                for c, s in (("g", scale[0]), ("h", scale[1])):
                    q = self._quantised(F.col(f"{c}{k}"), s, iteration, f"{c}{k}")
                    columns.append((q if bag is None else F.when(bag, q)).alias(f"q{c}{b * self.classes + k}"))
                slots.append((f"qg{b * self.classes + k}", f"qh{b * self.classes + k}"))
        if isinstance(self.state, BlockRows):
            packed = None if grader is None else pack_graded(self.state.blocks, grader, scale, len(self.specs), self.state.wide, values)
            kept = RoundBlocks(self.state, lambda ways, held: self.gradients(self._scored(weighed, ways, held), iteration).select("*", *columns), slots, packed, p.part_rows)
        else:
            kept = self._kept_rows(graded, columns, slots)
        needs_roots = p.tree.path_smooth > 0 or p.tree.monotone_constraints or p.tree.monotone_penalty > 0 or p.tree.forced_splits
        roots = [self._root(kept.narrow, *slot, scale) if needs_roots else (0.0, 0.0, tops["n"]) for slot in slots]
        names = [[s.name for s in self.specs]] * n_slots
        if p.feature_fraction < 1.0:
            names = [feature_sample(names[0], p.feature_fraction, p.tree.feature_fraction_seed, iteration, i) for i in range(n_slots)]
        trees, grown = grow_trees(kept.narrow, slots, roots, self.specs, p.tree, scale, names, self.used, iteration, p.subtract_rows, kept)
        for i, t in enumerate(trees):
            if not t.nodes and not needs_roots:  # no split was found, so the root's sums are still unknown
                g, h, n = self._root(kept.narrow, *slots[i], scale)
                t.leaves[0] = Leaf(plain_output(g, h, p.tree), h, n)
        for i, t in enumerate(trees):
            t.iteration, t.class_id = iteration + i // self.classes, i % self.classes
            self._finish(t, kept, grown, i, iteration)
        if self.factors is not None:
            self._move_factors(kept, scale)
        return trees, kept, grown

    def _written(self, graded: DataFrame) -> DataFrame:
        """A round's graded rows, bins aside, worked out once; those of the round before go."""
        spark = graded.sparkSession
        self._drop_graded()
        self.graded = f"{shared_folder(spark)}/graded_{uuid.uuid4().hex}"
        narrow = graded.drop("bins")
        narrow.write.parquet(self.graded)
        return spark.read.schema(narrow.schema).parquet(self.graded)

    def _drop_graded(self) -> None:
        if self.graded is not None:
            discard(self.state.spark, self.graded)
            self.graded = None

    def _kept_rows(self, graded: DataFrame, columns: list[Column], slots: list[tuple[str, str]]) -> RoundRows:
        carried = [*self.state.changing, *[c for c in ("goss_weight", START) if c in graded.columns]]
        narrow = graded.select(ROW, *carried, *columns)
        if self.objective in RANKING:  # ranking has dealt the rows by group
            narrow = narrow.repartition(self.state.buckets, ROW)
        keep = [*carried, *[x for s in slots for x in s]]
        return RoundRows(self.state, narrow, keep, len(slots), self.p.store_levels, slots, self.p.part_rows)

    def _move_factors(self, kept: RoundRows, scale: tuple[float, float]) -> None:
        """A step of the position factors on the round's kept gradients, those of its (first) sample of rows."""
        g, h = F.col("qg0") / scale[0], F.col("qh0") / scale[1]
        rows = self.state.fixed.select(ROW, "position").join(kept.narrow.select(ROW, "qg0", "qh0").hint("shuffle_hash"), ROW)
        self.factors = self.factors.stepped(rows, self.p.learning_rate, self.op.position_bias_regularization, g, h)

    @property
    def position_factors(self) -> DataFrame | None:
        return None if self.factors is None else self.factors.table

    def _limits(self, graded: DataFrame) -> dict | None:
        """Row count and largest |g| and |h| per class of losses with known limits, which need no pass."""
        if self.objective in ("binary", "multiclass", "multiclassova", "cross_entropy") and self.p.data_sample_strategy != "goss":
            if self.limits is None:
                weight = F.max("weight") if "weight" in graded.columns else F.lit(1.0)
                r = self.state.fixed.agg(F.count(F.lit(1)).alias("n"), weight.alias("w")).first()
                top = float(r["w"] or 1.0) * max(self.op.scale_pos_weight, 1.0) * max(self.op.sigmoid, 1.0) ** 2
                self.limits = {"n": r["n"], **{f"{c}{k}": top for c in "gh" for k in range(self.classes)}}
            return self.limits
        return None

    def _tops(self, graded: DataFrame) -> dict:
        """Row count and largest |g| and |h| per class."""
        return self._limits(graded) or graded.agg(
            F.count("g0").alias("n"),
            *[F.max(F.abs(f"{c}{k}")).alias(f"{c}{k}") for c in "gh" for k in range(self.classes)],
        ).first().asDict()

    def _root(self, work: DataFrame, g: str, h: str, scale: tuple[float, float]) -> tuple[float, float, int]:
        r = work.agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count(g).alias("n")).first()
        return (r["g"] or 0) / scale[0], (r["h"] or 0) / scale[1], r["n"]

    def _scales(self, tops) -> tuple[float, float]:
        biggest = [max(tops[f"{c}{k}"] or 0.0 for k in range(self.classes)) or 1.0 for c in "gh"]
        if self.p.use_quantized_grad:
            half = self.p.num_grad_quant_bins / 2
            return half / biggest[0], self.p.num_grad_quant_bins / biggest[1]
        # The largest power of two for which no sum over all rows can overflow a bigint.
        bits = [62 - math.ceil(math.log2(max(b * tops["n"], 1e-300))) for b in biggest]
        return 2.0 ** min(bits[0], 52), 2.0 ** min(bits[1], 52)

    def _quantised(self, x: Column, scale: float, iteration: int, name: str) -> Column:
        if self.p.use_quantized_grad and self.p.stochastic_rounding:
            u = hash_unit(F.col("row_id"), iteration, zlib.crc32(name.encode()))
            return F.floor(x * scale + u).cast("bigint")
        return fixed_point(x, scale)

    def _finish(self, t: Tree, kept: RoundRows | RoundBlocks, grown: list, slot: int, iteration: int) -> None:
        """Leaf renewal by percentile, by exact gradients, or by linear models."""
        k = t.class_id
        renews = self.p.use_quantized_grad and self.p.quant_train_renew_leaf
        if not (self.objective in RENEWED or renews or self.p.linear_tree and t.iteration > 0):
            return
        inside = kept.leafed(grown).where(F.col(f"qg{slot}").isNotNull()).withColumnRenamed(f"leaf{slot}", "leaf")
        if self.objective in RENEWED:
            y = F.col("label").cast("double")
            w = F.col("weight") if "weight" in inside.columns else F.lit(1.0)
            if self.objective == "mape":
                w = w / F.greatest(F.lit(1.0), F.abs(y))
            weighted = self.objective == "mape" or "weight" in inside.columns
            place = F.monotonically_increasing_id() if isinstance(kept, RoundBlocks) else F.col(ROW)
            rows = inside.select("leaf", (y - F.col("scores")[0]).alias("residual"), w.alias("weight"), place.alias("row_id"))
            alpha = self.op.alpha if self.objective == "quantile" else 0.5
            for r in renew_leaf_percentile(rows, alpha, weighted=weighted).collect():  # one row per leaf
                t.leaves[r["leaf"]].value = r["renewed"]
        if not renews and not self.p.linear_tree:
            return
        share = F.col("goss_weight") if "goss_weight" in inside.columns else F.lit(1.0)
        graded = self.gradients(inside, iteration).withColumns({"g": F.col(f"g{k}") * share, "h": F.col(f"h{k}") * share})
        if renews and self.objective not in RENEWED:
            for r in graded.groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # one row per leaf
                t.leaves[r["leaf"]].value = plain_output(r["g"], r["h"], self.p.tree)
        if self.p.linear_tree and t.iteration > 0:
            linear_leaves(graded, t, F.col("leaf"), self.p.linear_lambda)

    def leaf_value(self, t: Tree, leaf: Column) -> Column:
        """A tree's value for rows whose leaf is known."""
        if self.p.linear_tree and any(x.const is not None for x in t.leaves):
            value = F.lit(0.0)
            for i, x in enumerate(t.leaves):
                linear = F.lit(x.const if x.const is not None else x.value)
                lost = F.lit(False)
                for f, c in x.coeffs.items():
                    linear = linear + c * F.col(f)
                    lost = lost | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
                value = F.when(leaf == i, F.when(lost, F.lit(x.value)).otherwise(linear)).otherwise(value)
            return value
        return F.get(F.expr(f"array({', '.join(f'{x.value!r}D' for x in t.leaves)})"), leaf)

    def tree_value(self, t: Tree) -> Column:
        return self.leaf_value(t, binned_leaf(t, self.specs))

    def _summed(self, trees: list[Tree], leaves: list[Column]) -> Column:
        parts = [F.col("scores")[k] for k in range(self.classes)]
        for t, leaf in zip(trees, leaves):
            parts[t.class_id] = parts[t.class_id] + self.leaf_value(t, leaf)
        return F.array(*parts)

    def _walked(self, trees: list[Tree]) -> list[Column]:
        return [binned_leaf(t, self.specs) for t in trees]

    def advance(self, trees: list[Tree], kept: RoundRows | RoundBlocks, grown: list) -> None:
        """Add a round's trees to every scored table: the leaves of the training rows are known."""
        leaves = [F.col(f"leaf{i}") for i in range(len(trees))]
        if isinstance(self.state, BlockRows) and not self.p.linear_tree:
            self.state.advance([t.leaf_way() for t in grown], [(t.class_id, [x.value for x in t.leaves]) for t in trees])
        elif isinstance(self.state, BlockRows):
            self.state.rewrite(kept.leafed(grown, True).withColumn("scores", self._summed(trees, leaves)))
        else:
            self.state.rewrite(kept.leafed(grown).withColumn("scores", self._summed(trees, leaves)))
        for v in self.valid.values():
            v.rewrite(v.rows.withColumn("scores", self._summed(trees, self._walked(trees))))

    def remember(self, trees: list[Tree], kept: RoundRows | RoundBlocks, grown: list) -> None:
        """Append the leaves of a round's trees to the leaf-number matrix of every table."""
        own = F.array(*[F.col(f"leaf{i}").cast("smallint") for i in range(len(trees))])
        if isinstance(self.state, BlockRows):
            self.state.advance([t.leaf_way() for t in grown], None)
        else:
            self.state.rewrite(kept.leafed(grown).withColumn("leaves", F.concat("leaves", own)).withColumn("scores", F.col(START)))
        new = F.array(*[leaf.cast("smallint") for leaf in self._walked(trees)])
        for v in self.valid.values():
            v.rewrite(v.rows.withColumn("leaves", F.concat("leaves", new)))

    def average(self, trees: list[Tree], iteration: int) -> None:
        """Move the validation scores to the mean of `iteration` + 1 trees, as a forest scores."""
        starts = [F.lit(float(s)) for s in self.starts]
        for v in self.valid.values():
            parts = [F.col("scores")[k] for k in range(self.classes)]
            for t in trees:
                k = t.class_id
                before = (parts[k] - starts[k]) * (iteration / (iteration + 1.0))
                parts[k] = starts[k] + before + self.tree_value(t) / (iteration + 1.0)
            v.rewrite(v.rows.withColumn("scores", F.array(*parts)))

    def model(self) -> Model:
        trees = list(self.trees)
        if self.p.boosting == "rf":
            trees = [t.shifted(self.starts[t.class_id]) for t in trees]
        elif any(self.starts):
            trees = [t.shifted(self.starts[t.class_id]) if t.iteration == 0 else t for t in trees]
        if self.init is not None:
            offset = self.init.iterations
            moved = [Tree(t.nodes, t.leaves, t.iteration + offset, t.class_id) for t in trees]
            trees = [*self.init.trees, *moved]
        op = {k: v for k, v in self.op.__dict__.items() if k != "custom" and v is not None}
        return Model(trees, self.features, self.objective, self.classes, self.p.boosting == "rf", {"objective_params": op})

    @property
    def metrics(self) -> tuple[str | M.CustomMetric, ...]:
        """The metrics asked for; none given means the objective's own."""
        return self.p.metric or OWN_METRICS.get(self.objective, ())

    def _metric_settings(self, metric: str | M.CustomMetric, columns: list[str]) -> dict:
        """Row or group weights and those settings of the objective that its metric shares."""
        if isinstance(metric, M.CustomMetric):
            return {}
        base = metric.partition("@")[0]
        out = {"weight": "weight"} if "weight" in columns else {}
        if base in M.pointwise_losses():
            out |= {"alpha": self.op.alpha, "fair_c": self.op.fair_c, "rho": self.op.tweedie_variance_power}
        if base == "auc_mu":
            out["classes"] = self.classes
        if base == "ndcg" and self.op.label_gain:
            out["gains"] = list(self.op.label_gain)
        return out

    def evaluate(self, trees: list[Tree] = (), tree_weights: list[float] | None = None) -> dict[str, float]:
        """Metrics of every validation table; with tree weights, of the weighted trees."""
        out = {}
        for name, state in self.valid.items():
            v = state.rows if tree_weights is None else weighted_scores(state.rows, trees, tree_weights, self.classes)
            raw = F.col("scores") if self.classes > 1 else F.col("scores")[0]
            shaped = v.withColumn("raw", raw).withColumn("prediction", output(self.objective, raw, self.op))
            shaped = shaped.withColumn("score", raw)
            for metric in self.metrics:
                extra = self._metric_settings(metric, v.columns)
                if self.classes > 1:
                    shaped = shaped.withColumn("probabilities", F.col("prediction")).withColumn("scores", F.col("prediction"))
                out[f"{name}:{M.metric_name(metric)}"] = M.evaluate(shaped, metric, **extra).first()["value"]
        return out


# What each objective is measured by when no metric is named.
OWN_METRICS = {
    "regression": ("l2",), "regression_l1": ("l1",), "huber": ("huber",), "fair": ("fair",), "poisson": ("poisson",),
    "quantile": ("quantile",), "mape": ("mape",), "gamma": ("gamma",), "tweedie": ("tweedie",), "binary": ("binary_logloss",),
    "multiclass": ("multi_logloss",), "multiclassova": ("multi_logloss",), "cross_entropy": ("cross_entropy",),
    "cross_entropy_lambda": ("cross_entropy_lambda",), "lambdarank": tuple(f"ndcg@{k}" for k in range(1, 6)),
    "rank_xendcg": tuple(f"ndcg@{k}" for k in range(1, 6)),
}


def _has_split(trees: list[Tree]) -> bool:
    return any(t.nodes for t in trees)


def train(
    df: DataFrame, features: list[str], params: TrainParams = TrainParams(), categorical: list[str] = (),
    valid: dict[str, DataFrame] | None = None, init_model: Model | None = None, specs: list[FeatureBins] | None = None,
    on_round: Callable[[int, Model], None] | None = None,
) -> TrainResult:
    """Train on a table with row_id, label, feature columns and optional weight, group_id, init_score, position.

    With `lambdarank`, a position column adds a factor per position, learned as the trees are (`position_bias`).
    """
    if params.boosting == "rf" and (params.bagging_freq <= 0 or min(params.bagging_fraction, params.feature_fraction) >= 1.0):
        raise ValueError("a forest needs bagging_freq > 0 and bagging_fraction or feature_fraction below 1: its trees would all be alike")
    run = _Run(df, features, params, categorical, specs, init_model, valid)
    try:
        if params.boosting == "rf":
            return _train_forest(run)
        return _train_dart(run) if params.boosting == "dart" else _train_boosted(run, on_round)
    finally:
        run.close()


def _train_boosted(run: _Run, on_round: Callable[[int, Model], None] | None) -> TrainResult:
    params = run.p
    stopper = EarlyStopping(params)
    history: list[dict[str, float]] = []
    for i in range(params.num_iterations):
        trees, kept, grown = run.build(i)
        if not _has_split(trees):
            if i == 0:  # a constant model still carries the starting score
                run.trees += [Tree([], [Leaf()], 0, k) for k in range(run.classes)]
            _let_go(kept)
            break
        trees = [t.scaled(params.learning_rate) for t in trees]
        run.trees += trees
        run.advance(trees, kept, grown)
        kept.close()
        if run.valid and run.metrics:
            history.append(run.evaluate())
            if stopper.update(i, history[-1]):
                break
        if on_round:
            on_round(i, run.model())
    best = stopper.best_iteration if params.early_stopping_round > 0 and history else len({t.iteration for t in run.trees})
    return TrainResult(run.model(), history, best, run.specs, run.position_factors)


def _let_go(kept: RoundRows | None) -> None:
    if kept is not None:
        kept.close()


class EarlyStopping:
    """Stop when a validation metric has not improved by `min_delta` for the set rounds."""

    def __init__(self, params: TrainParams):
        self.p = params
        self.best: dict[str, tuple[float, int]] = {}
        self.best_iteration = 0
        self.own = {m.name: m.larger_is_better for m in params.metric if isinstance(m, M.CustomMetric)}

    def _larger(self, metric: str) -> bool:
        return self.own[metric] if metric in self.own else M.larger_is_better(metric)

    def update(self, iteration: int, values: dict[str, float]) -> bool:
        stop = False
        watched = [k for k in values if not self.p.first_metric_only or k.split(":", 1)[1] == next(iter(values)).split(":", 1)[1]]
        for key in watched:
            sign = 1.0 if self._larger(key.split(":", 1)[1]) else -1.0
            score = sign * values[key]
            best = self.best.get(key)
            if best is None or score > best[0] + self.p.early_stopping_min_delta:
                self.best[key] = (score, iteration)
            elif 0 < self.p.early_stopping_round <= iteration - best[1]:
                stop = True
                self.best_iteration = best[1] + 1
        if not stop and watched:
            self.best_iteration = self.best[watched[0]][1] + 1
        return stop


def _train_forest(run: _Run) -> TrainResult:
    """Independent trees on bags of the rows; several share each pass over the data."""
    p = run.p
    together = max(1, p.trees_together // run.classes)
    stopper, history = EarlyStopping(p), []
    for first in range(0, p.num_iterations, together):
        ids = range(first, min(first + together, p.num_iterations))
        trees, kept, _ = run.build(first, [run.sampled(run.state.fixed, i) for i in ids])
        _let_go(kept)
        for i in ids if run.valid and run.metrics else ():
            new = [t for t in trees if t.iteration == i]
            run.trees += new
            run.average(new, i)
            history.append(run.evaluate())
            if stopper.update(i, history[-1]):
                return TrainResult(run.model(), history, stopper.best_iteration, run.specs, run.position_factors)
        if not history:
            run.trees += trees
    best = stopper.best_iteration if p.early_stopping_round > 0 and history else p.num_iterations
    return TrainResult(run.model(), history, best, run.specs, run.position_factors)


def _train_dart(run: _Run) -> TrainResult:
    """Boosting with dropped trees (Rashmi & Gilad-Bachrach 2015).

    Each row keeps its leaf number in every tree, so a changed set of tree weights is one
    expression over a short array rather than a walk of all trees.
    """
    p = run.p
    rng = random.Random(p.drop_seed)
    stopper, history = EarlyStopping(p), []
    raw: list[Tree] = []
    weights: list[float] = []
    done = 0
    for i in range(p.num_iterations):
        drop: list[int] = []
        rounds = range(done)
        if rounds and rng.random() >= p.skip_drop:
            mean = sum(weights[r] for r in rounds) / done if not p.uniform_drop else 1.0
            for r in rounds:
                chance = p.drop_rate if p.uniform_drop else p.drop_rate * weights[r] / mean
                if rng.random() < chance:
                    drop.append(r)
                if p.max_drop > 0 and len(drop) >= p.max_drop:
                    break
        kept = [0.0 if r in drop else w for r, w in enumerate(weights)]
        trees, rows, grown = run.build(i, weighed=(raw, kept))
        if not _has_split(trees):
            _let_go(rows)
            break
        k = len(drop)
        if p.xgboost_dart_mode:
            fresh = p.learning_rate / (k + p.learning_rate) if k else p.learning_rate
            factor = k / (k + p.learning_rate)
        else:
            fresh, factor = p.learning_rate / (k + 1), k / (k + 1)
        for r in drop:
            weights[r] *= factor
        weights.append(fresh)
        raw += trees
        run.remember(trees, rows, grown)
        rows.close()
        done += 1
        if run.valid and run.metrics:
            history.append(run.evaluate(raw, weights))
            if stopper.update(i, history[-1]):
                break
    run.trees = [t.scaled(weights[t.iteration]) for t in raw]
    best = stopper.best_iteration if p.early_stopping_round > 0 and history else done
    return TrainResult(run.model(), history, best, run.specs, run.position_factors)


def weighted_scores(rows: DataFrame, trees: list[Tree], weights: list[float], classes: int, leaves: str = "leaves") -> DataFrame:
    """Scores as the start plus the weighted values of the trees, looked up by leaf number."""
    if not trees:
        return rows
    values = ", ".join(f"array({', '.join(f'{weights[t.iteration] * x.value!r}D' for x in t.leaves)})" for t in trees)
    parts = []
    for k in range(classes):
        mine = f"CASE WHEN i % {classes} = {k} THEN get(get(array({values}), i), leaf) ELSE 0D END"
        parts.append(f"get(scores, {k}) + aggregate(transform({leaves}, (leaf, i) -> {mine}), 0D, (a, x) -> a + x)")
    return rows.withColumn("scores", F.expr(f"array({', '.join(parts)})"))


def refit(df: DataFrame, model: Model, params: TrainParams, decay: float = 0.9) -> Model:
    """Keep the trees' shapes, blend their leaf values with those of new data.

    One pass finds every row's leaf in every tree, and only labels, weights, scores and these short
    arrays are kept. Trees are refitted in order, each on the scores of those before it; a round, with
    all its classes, is one grouped aggregate over the kept rows.
    """
    op, classes = params.objective_params, model.num_class
    names = [c for c in ("label", "weight") if c in df.columns]
    walked = predict_leaf(df, model, "__leaves")
    start = F.array(*[F.lit(0.0)] * classes)
    rows = cut_lineage(walked.select(*names, start.alias("scores"), F.col("__leaves").cast("array<smallint>").alias("leaves")))
    weight = F.col("weight") if "weight" in names else None
    out: list[Tree] = []
    folded = 0  # trees whose values are in the kept scores
    for i in range(model.iterations):
        now = [(at, t) for at, t in enumerate(model.trees) if t.iteration == i]
        scored = _with_values(rows, list(enumerate(out))[folded:], classes)
        cells = []
        for at, t in now:
            if model.objective in MULTI:
                g, h = class_gradients(model.objective, F.col("label"), F.col("scores"), t.class_id, op, weight)
            else:
                g, h = row_gradients(model.objective, F.col("label"), F.col("scores")[0], op, weight)
            cells.append(F.struct(F.lit(at).alias("tree"), F.col("leaves")[at].alias("leaf"), g.alias("g"), h.alias("h")))
        sums = scored.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.tree", "c.leaf")
        fresh = {(r["tree"], r["leaf"]): r for r in sums.agg(F.sum("c.g").alias("g"), F.sum("c.h").alias("h")).collect()}  # a row a leaf
        for at, t in now:
            leaves = []
            for j, x in enumerate(t.leaves):
                value = x.value
                if (at, j) in fresh:
                    new = params.learning_rate * plain_output(fresh[at, j]["g"], fresh[at, j]["h"], params.tree)
                    value = decay * x.value + (1.0 - decay) * new
                leaves.append(Leaf(value, x.weight, x.count, x.depth))
            out.append(Tree(t.nodes, leaves, t.iteration, t.class_id))
        if (i + 1) % params.checkpoint_every == 0 and i + 1 < model.iterations:
            rows = cut_lineage(_with_values(rows, list(enumerate(out))[folded:], classes))
            folded = len(out)
    return Model(out, model.features, model.objective, classes, model.average, model.params)


def _with_values(rows: DataFrame, trees: list[tuple[int, Tree]], classes: int) -> DataFrame:
    """Scores plus the values of these trees, looked up by place in the leaf-number matrix."""
    parts = []
    for k in range(classes):
        terms = [f"get(array({', '.join(f'{x.value!r}D' for x in t.leaves)}), leaves[{at}])" for at, t in trees if t.class_id == k]
        parts.append(" + ".join([f"scores[{k}]", *terms]))
    return rows.withColumn("scores", F.expr(f"array({', '.join(parts)})"))
