"""Histograms, split search and best-first tree growth.

Rows carry an array of bins and fixed-point gradients. One level of growth is one job: all
open nodes of all trees under way are summed into (slot, node, feature, bin) histograms,
and only each node's best split, one row, comes back to the driver. Sums are of bigints,
so they do not depend on how rows are partitioned.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.operators.binning import FeatureBins
from paddock.operators.blocks import TASK_SUMS, Asked, Step, histograms
from paddock.operators.model import Leaf, Node, Tree
from paddock.operators.prefix import first_rows
from paddock.operators.scoring import _binned_left, bin_reads
from paddock.operators.sparse import sparse_histogram
from paddock.operators.state import RoundBlocks, RoundRows


@dataclass(frozen=True)
class TreeParams:
    """Settings of one tree. Defaults are fixed values."""

    num_leaves: int = 31
    max_depth: int = -1
    min_data_in_leaf: int = 20
    min_sum_hessian_in_leaf: float = 1e-3
    min_gain_to_split: float = 0.0
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    max_delta_step: float = 0.0
    path_smooth: float = 0.0
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 32
    cat_l2: float = 10.0
    cat_smooth: float = 10.0
    min_data_per_group: int = 100
    monotone_constraints: dict[str, int] = field(default_factory=dict)
    monotone_penalty: float = 0.0
    interaction_constraints: tuple[tuple[str, ...], ...] = ()
    feature_contri: dict[str, float] = field(default_factory=dict)
    extra_trees: bool = False
    extra_seed: int = 6
    feature_fraction_bynode: float = 1.0
    feature_fraction_seed: int = 2
    cegb_tradeoff: float = 1.0
    cegb_penalty_split: float = 0.0
    cegb_penalty_feature_lazy: dict[str, float] = field(default_factory=dict)
    cegb_penalty_feature_coupled: dict[str, float] = field(default_factory=dict)
    forced_splits: dict | None = None


# --- the operators ---


def gradient_histogram(rows: DataFrame, keys: list[str], wanted: list[int] | None = None) -> DataFrame:
    """(keys, feature, bin, g, h, n): sums per bin of rows with columns bins, g, h.

    `wanted` restricts the features. Partial sums combine before the shuffle, so what moves
    is at most tasks x keys x features x bins, whatever the number of rows.
    """
    cells = rows.select(*keys, "g", "h", F.posexplode("bins").alias("feature", "bin"))
    if wanted is not None:
        cells = cells.where(F.col("feature").isin(*wanted))
    return cells.groupBy(*keys, "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")
    )


def histogram_merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Element-wise sum of partial histograms."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def histogram_subtract(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """Sibling histogram: parent less child, empty bins dropped."""
    on = [*keys, "feature", "bin"]
    small = child.select(*on, *[F.col(c).alias(f"__{c}") for c in ("g", "h", "n")])
    rest = [(F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("g", "h", "n")]
    return parent.join(small, on, "left").select(*on, *rest).where(F.col("n") > 0)


def soft_threshold(g: Column, l1: float) -> Column:
    if l1 == 0.0:
        return g
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def leaf_output(g: Column, h: Column, p: TreeParams, l2: float | None = None) -> Column:
    """-soft(G) / (H + l2), kept within max_delta_step; NaN becomes 0."""
    raw = -soft_threshold(g, p.lambda_l1) / (h + (p.lambda_l2 if l2 is None else l2))
    if p.max_delta_step > 0:
        raw = F.greatest(F.least(raw, F.lit(p.max_delta_step)), F.lit(-p.max_delta_step))
    return F.nanvl(F.coalesce(raw, F.lit(0.0)), F.lit(0.0))


def leaf_values(rows: DataFrame, p: TreeParams, rate: float, scale: tuple[float, float] = (1.0, 1.0), leaf: str = "leaf") -> DataFrame:
    """(leaf, value, weight, count) from rows with leaf, g, h."""
    sums = rows.groupBy(leaf).agg(
        (F.sum("g") / scale[0]).alias("g"), (F.sum("h") / scale[1]).alias("weight"), F.count(F.lit(1)).alias("count")
    )
    value = F.when(F.col("weight") + p.lambda_l2 == 0, F.lit(0.0)).otherwise(leaf_output(F.col("g"), F.nullif("weight", F.lit(-p.lambda_l2)), p))
    return sums.select(leaf, (value * rate).alias("value"), "weight", "count")


def smoothed(w: Column, n: Column, parent: Column, smooth: float) -> Column:
    """Leaf value pulled toward its parent's: the fewer rows, the more."""
    if smooth <= 0:
        return w
    share = n / smooth
    return w * share / (share + 1.0) + parent / (share + 1.0)


def _by_feature(values: list, default) -> Column:
    return F.get(F.array(*[F.lit(default if v is None else v) for v in values]), F.col("feature"))


class _Steps:
    """Projections and filters gathered as nested SQL text, so that a chain of them is analysed once."""

    def __init__(self, source: DataFrame, text: str = "{source}"):
        self.source, self.text = source, text

    def selectExpr(self, *columns: str) -> _Steps:
        return _Steps(self.source, f"(SELECT {', '.join(columns)} FROM {self.text})")

    def where(self, condition: str) -> _Steps:
        return _Steps(self.source, f"(SELECT * FROM {self.text} WHERE {condition})")

    def done(self) -> DataFrame:
        return self.source.sparkSession.sql(f"SELECT * FROM {self.text}", source=self.source)


_SUMS = ("lg", "lh", "ln", "tg", "th", "tn")


def _sides(cuts: _Steps, p: TreeParams, scale: tuple[float, float], l2: float, plain: bool) -> DataFrame:
    """Allowed cuts with both outputs (lw, rw) and the gain.

    The gain of a leaf with output w is -(2 soft(G) w + (H + l2) w^2), which is
    soft(G)^2 / (H + l2) for the best w. `lo`, `hi`, `parent_value` exist unless `plain`.
    Plain SQL text, so that a level of growth costs few calls to build.
    """

    def soft(g: str) -> str:
        return g if p.lambda_l1 == 0 else f"(signum({g}) * greatest(abs({g}) - {p.lambda_l1!r}D, 0D))"

    def out(g: str, h: str, ridge: float) -> str:
        w = f"(-{soft(g)} / nullif({h} + {ridge!r}D, 0D))"
        if p.max_delta_step > 0:
            w = f"greatest(least({w}, {p.max_delta_step!r}D), {-p.max_delta_step!r}D)"
        return f"coalesce({w}, 0D)"

    def kept(w: str, n: str) -> str:
        if plain:
            return w
        if p.path_smooth > 0:
            share = f"({n} / {p.path_smooth!r}D)"
            w = f"({w} * {share} / ({share} + 1D) + parent_value / ({share} + 1D))"
        return f"greatest(least({w}, hi), lo)"

    def gain(g: str, h: str, w: str, ridge: float) -> str:
        return f"(-(2D * {soft(g)} * {w} + ({h} + {ridge!r}D) * {w} * {w}))"

    few = max(p.min_data_in_leaf, 1)
    allowed = (
        f"ln >= {few} AND tn - ln >= {few} AND lh / {scale[1]!r}D >= {p.min_sum_hessian_in_leaf!r}D "
        f"AND (th - lh) / {scale[1]!r}D >= {p.min_sum_hessian_in_leaf!r}D"
    )
    real = cuts.where(allowed).selectExpr(
        "*", f"lg / {scale[0]!r}D AS a", f"lh / {scale[1]!r}D AS b", f"(tg - lg) / {scale[0]!r}D AS c",
        f"(th - lh) / {scale[1]!r}D AS d", f"tg / {scale[0]!r}D AS e", f"th / {scale[1]!r}D AS f",
    )
    if plain and p.max_delta_step <= 0:
        best = lambda g, h, ridge: f"coalesce({soft(g)} * {soft(g)} / nullif({h} + {ridge!r}D, 0D), 0D)"
        both = real.selectExpr(
            "*", f"{out('a', 'b', l2)} AS lw", f"{out('c', 'd', l2)} AS rw",
            f"{best('a', 'b', l2)} + {best('c', 'd', l2)} AS parts", f"{best('e', 'f', p.lambda_l2)} AS whole",
        )
    else:
        valued = real.selectExpr(
            "*", f"{kept(out('a', 'b', l2), 'ln')} AS lw", f"{kept(out('c', 'd', l2), '(tn - ln)')} AS rw",
            f"{out('e', 'f', p.lambda_l2) if plain else 'parent_value'} AS w",
        )
        both = valued.selectExpr(
            "*", f"{gain('a', 'b', 'lw', l2)} + {gain('c', 'd', 'rw', l2)} AS parts", f"{gain('e', 'f', 'w', p.lambda_l2)} AS whole"
        )
    # A difference within rounding of its parts is no gain.
    return both.selectExpr("*", "nanvl(CASE WHEN abs(parts - whole) <= 1e-12 * abs(parts) THEN 0D ELSE parts - whole END, 0D) AS gain").done()


def split_gain(
    hist: DataFrame, keys: list[str], specs: list[FeatureBins], p: TreeParams, scale: tuple[float, float] = (1.0, 1.0),
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Every allowed numeric cut of a histogram with its gain, for both homes of missing values.

    `nodes` (keys, lo, hi, parent_value, depth, allowed) is needed only by options that look
    beyond the histogram; it has one row per open node and is broadcast. Windows run over
    the bins of one node and feature, at most the bin limit.
    """
    numeric = [i for i, s in enumerate(specs) if s.kind == "numeric"]
    if not numeric:
        return _candidates_schema(hist.limit(0), keys)
    h = hist if nodes is None else hist.join(F.broadcast(nodes), keys)
    h = _Steps(h) if len(numeric) == len(specs) else _Steps(h).where(f"feature IN ({', '.join(map(str, numeric))})")
    gone = [i for i in numeric if specs[i].missing_bin >= 0]
    lost = " OR ".join(f"(feature = {i} AND bin = {specs[i].missing_bin})" for i in gone) or "FALSE"
    carried = [*keys, "feature", "bin", *([] if nodes is None else ["lo", "hi", "parent_value", "depth", "allowed"])]
    part = f"PARTITION BY {', '.join(keys)}, feature"
    upto, whole = f"({part} ORDER BY bin ROWS UNBOUNDED PRECEDING)", f"({part} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    sums = h.selectExpr(*carried, "g", "h", "n", f"({lost}) AS lost").selectExpr(
        *carried, "lost",
        *[f"sum(CASE WHEN lost THEN 0L ELSE {c} END) OVER {upto} AS l{c}" for c in "ghn"],
        *[f"sum({c}) OVER {whole} AS t{c}" for c in "ghn"],
        *([f"sum(CASE WHEN lost THEN {c} ELSE 0L END) OVER {whole} AS m{c}" for c in "ghn"] if gone else []),
    ).where("NOT lost")
    if gone:
        homes = sums.selectExpr("*", "explode(CASE WHEN mn > 0 THEN array(FALSE, TRUE) ELSE array(FALSE) END) AS default_left")
        moved = [f"l{c} + CASE WHEN default_left THEN m{c} ELSE 0L END AS l{c}" for c in "ghn"]
    else:
        homes, moved = sums.selectExpr("*", "FALSE AS default_left"), ["lg", "lh", "ln"]
    cuts = homes.selectExpr(*carried, "default_left", *moved, "tg", "th", "tn")
    return _candidates_schema(_sides(cuts, p, scale, p.lambda_l2, nodes is None), keys)


def _candidates_schema(df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns every candidate split has."""
    have = set(df.columns)
    fill = {"default_left": "FALSE", "cats": "CAST(array() AS ARRAY<INT>)", "gain": "0D", "lw": "0D", "rw": "0D"}
    filled = [c if c in have else f"{fill.get(c, '0L')} AS {c}" for c in ("default_left", "cats", "gain", *_SUMS, "lw", "rw")]
    return df.selectExpr(*keys, "feature", "bin", *filled, *[c for c in ("depth", "allowed") if c in have])


def categorical_split(
    hist: DataFrame, keys: list[str], specs: list[FeatureBins], p: TreeParams, scale: tuple[float, float] = (1.0, 1.0),
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Candidate category sets: one against the rest for few categories, else prefixes of the
    categories ordered by g / (h + cat_smooth), from either end. Bin 0 never goes left."""
    categorical = [i for i, s in enumerate(specs) if s.kind == "categorical"]
    if not categorical:
        return _candidates_schema(hist.limit(0), keys)
    h = hist.where(F.col("feature").isin(*categorical))
    if nodes is not None:
        h = h.join(F.broadcast(nodes), keys)
    whole = W.partitionBy(*keys, "feature")
    for c in ("g", "h", "n"):
        h = h.withColumn(f"t{c}", F.sum(c).over(whole))
    h = h.withColumn("ratio", (F.col("g") / scale[0]) / (F.col("h") / scale[1] + p.cat_smooth)).where(F.col("bin") > 0)
    few = _by_feature([len(s.categories) <= p.max_cat_to_onehot for s in specs], False)
    single = h.where(few).withColumn("cats", F.array("bin"))
    for c in ("g", "h", "n"):
        single = single.withColumn(f"l{c}", F.col(c))
    parts = [_sides(_Steps(single), p, scale, p.lambda_l2, nodes is None)]
    for order in (F.col("ratio").asc(), F.col("ratio").desc()):
        at = W.partitionBy(*keys, "feature").orderBy(order, "bin")
        upto = at.rowsBetween(W.unboundedPreceding, 0)
        many = h.where(~few).withColumn("place", F.row_number().over(at)).withColumn("cats", F.collect_list("bin").over(upto))
        for c in ("g", "h", "n"):
            many = many.withColumn(f"l{c}", F.sum(c).over(upto))
        enough = (F.col("ln") >= p.min_data_per_group) & (F.col("tn") - F.col("ln") >= p.min_data_per_group)
        many = many.where((F.col("place") <= p.max_cat_threshold) & enough)
        parts.append(_sides(_Steps(many), p, scale, p.lambda_l2 + p.cat_l2, nodes is None))
    out = _candidates_schema(parts[0], keys)
    for part in parts[1:]:
        out = out.unionByName(_candidates_schema(part, keys))
    return out


def adjust_gain(cuts: DataFrame, specs: list[FeatureBins], p: TreeParams, used: frozenset[str] = frozenset()) -> DataFrame:
    """Options that change or veto gains: multipliers, monotone direction and penalty, costs."""
    costs = p.cegb_penalty_split > 0 or p.cegb_penalty_feature_coupled or p.cegb_penalty_feature_lazy
    if not (p.feature_contri or p.monotone_constraints or costs):
        return cuts
    names = [s.name for s in specs]
    gain = F.col("gain")
    if p.feature_contri:
        gain = gain * F.greatest(_by_feature([float(p.feature_contri.get(f, 1.0)) for f in names], 1.0), F.lit(0.0))
    if p.monotone_constraints:
        direction = _by_feature([int(p.monotone_constraints.get(f, 0)) for f in names], 0)
        cuts = cuts.where((direction == 0) | ((F.col("rw") - F.col("lw")) * direction >= 0))
        if p.monotone_penalty > 0 and "depth" in cuts.columns:
            x, d = p.monotone_penalty, F.col("depth")
            soft = 1.0 - F.pow(F.lit(2.0), F.lit(x - 1.0) - d) if x > 1 else 1.0 - F.lit(x) / F.pow(F.lit(2.0), d)
            factor = F.when(F.lit(x) >= d + 1, F.lit(1e-15)).otherwise(soft + 1e-15)
            gain = F.when(direction != 0, gain * factor).otherwise(gain)
    cost = F.lit(0.0)
    if p.cegb_penalty_split > 0:
        cost = cost + p.cegb_tradeoff * p.cegb_penalty_split * F.col("tn")
    if p.cegb_penalty_feature_coupled:
        once = [float(p.cegb_penalty_feature_coupled.get(f, 0.0)) * (f not in used) for f in names]
        cost = cost + p.cegb_tradeoff * _by_feature(once, 0.0)
    if p.cegb_penalty_feature_lazy:
        each = [float(p.cegb_penalty_feature_lazy.get(f, 0.0)) * (f not in used) for f in names]
        cost = cost + p.cegb_tradeoff * _by_feature(each, 0.0) * F.col("tn")
    return cuts.withColumn("gain", gain - cost)


def random_cut(cuts: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One seeded cut per node and feature, as extremely randomised trees take."""
    u = F.xxhash64(*[F.col(k) for k in keys], "feature", "bin", F.lit(seed))
    return first_rows(cuts.withColumn("__u", u), [*keys, "feature"], [F.col("__u"), F.col("default_left")]).drop("__u")


def best_split(cuts: DataFrame, keys: list[str], p: TreeParams) -> DataFrame:
    """The best cut per node; equal gains go to the first feature, then the first bin."""
    good = cuts.where((F.col("gain") > p.min_gain_to_split) & ~F.isnan("gain"))
    payload = [c for c in cuts.columns if c not in keys and c not in ("gain", "depth", "allowed")]
    ranked = F.struct(
        "gain", (-F.col("feature")).alias("r1"), (-F.col("bin")).alias("r2"), (~F.col("default_left")).alias("r3"),
        (-F.size("cats")).alias("r4"), *payload,
    )
    # A maximum combines before the shuffle, one row per node and task.
    best = good.groupBy(*keys).agg(F.max(ranked).alias("b"))
    return best.select(*keys, "b.gain", *[f"b.{c}" for c in payload])


def apply_split(rows: DataFrame, leaf: int, new_leaf: int, node: Node, features: list[str], column: str = "leaf") -> DataFrame:
    """Rows of one leaf routed left (keeping the leaf) or right (to `new_leaf`)."""
    left = F.expr(_binned_left(node, {f: f"bins[{i}]" for i, f in enumerate(features)}))
    return rows.withColumn(column, F.when((F.col(column) == leaf) & ~left, F.lit(new_leaf)).otherwise(F.col(column)))


# --- growth ---


@dataclass
class _Open:
    """A node of the explored tree: open until its best split is known."""

    id: int
    depth: int
    g: float
    h: float
    n: int
    value: float
    lo: float = float("-inf")
    hi: float = float("inf")
    branch: tuple[str, ...] = ()
    known: bool = False
    split: Node | None = None
    children: tuple[_Open, _Open] | None = None
    script: dict | None = None


def plain_output(g: float, h: float, p: TreeParams) -> float:
    if h + p.lambda_l2 <= 0:
        return 0.0
    soft = g if p.lambda_l1 == 0 else (1 if g > 0 else -1) * max(abs(g) - p.lambda_l1, 0.0)
    w = -soft / (h + p.lambda_l2)
    return max(-p.max_delta_step, min(p.max_delta_step, w)) if p.max_delta_step > 0 else w


class _Growing:
    """One tree under way: explored splits and the best-first choice among them."""

    def __init__(self, slot: int, root: tuple[float, float, int], specs: list[FeatureBins], p: TreeParams, features: list[str], used: set[str]):
        g, h, n = root
        self.slot, self.specs, self.p, self.features, self.used = slot, specs, p, features, used
        self.root = _Open(0, 0, g, h, n, plain_output(g, h, p) if h else 0.0, script=p.forced_splits)
        self.all = [self.root]
        self.stored = {self.root.id}  # nodes that rows may be kept at
        self.place: dict[int, int] = {}
        self.reads = bin_reads(specs)
        self.index = {s.name: i for i, s in enumerate(specs)}
        self.ordered = bool(p.cegb_penalty_feature_coupled or p.cegb_penalty_feature_lazy)

    def chosen(self) -> tuple[list[_Open], list[_Open], list[_Open]]:
        """Replay best-first choice: (split nodes in order, final leaves, nodes to look at next).

        The order in which leaves are split does not change any leaf's own best split, so
        replaying over known splits gives the tree that one-at-a-time growth would give.
        """
        heap: list[tuple[float, int, _Open]] = []
        splits, waiting = [], []
        leaves = [self.root]

        def offer(node: _Open) -> None:
            if not node.known:
                waiting.append(node)
            elif node.split is not None:
                rank = float("-inf") if node.script else -node.split.gain
                heapq.heappush(heap, (rank, node.id, node))

        offer(self.root)
        while heap and not waiting and len(leaves) < self.p.num_leaves:
            _, _, node = heapq.heappop(heap)
            splits.append(node)
            at = leaves.index(node)
            left, right = self._children(node)
            leaves[at] = left
            leaves.append(right)
            offer(left)
            offer(right)
        ahead = list(waiting)
        if waiting and not self.ordered:
            # Look at children of splits that are likely to be taken, up to the leaf budget.
            room = self.p.num_leaves - len(leaves)
            for _, _, node in sorted(heap)[:max(room, 0)]:
                ahead += [c for c in self._children(node) if not c.known]
        return splits, leaves, ahead

    def _children(self, node: _Open) -> tuple[_Open, _Open]:
        if node.children is None:
            s = node.split
            sums, (lw, rw) = s.__dict__["sums"], s.__dict__["outputs"]
            direction = self.p.monotone_constraints.get(s.feature, 0)
            middle = (lw + rw) / 2.0
            (ll, lh), (rl, rh) = (node.lo, node.hi), (node.lo, node.hi)
            if direction > 0:
                lh, rl = min(lh, middle), max(rl, middle)
            elif direction < 0:
                ll, rh = max(ll, middle), min(rh, middle)
            branch = (*node.branch, s.feature)
            script = node.script or {}
            made = []
            for k, (lo, hi) in enumerate(((ll, lh), (rl, rh))):
                g, h, n = sums[k]
                child = _Open(len(self.all), node.depth + 1, g, h, n, (lw, rw)[k], lo, hi, branch, script=script.get(("left", "right")[k]))
                if n < 2 * max(self.p.min_data_in_leaf, 1) or 0 < self.p.max_depth <= child.depth:
                    child.known = True
                made.append(child)
                self.all.append(child)
            node.children = (made[0], made[1])
        return node.children

    def _descend(self, column: str | None, at) -> str:
        """SQL of `at` below the node each row is kept at; without a column, below the root."""
        if column is None:
            return at(self.root)
        told = [(n.id, at(n)) for n in self.all if n.id in self.stored]
        return f"CASE {column} {' '.join(f'WHEN {i} THEN {text}' for i, text in told)} END"

    def _side(self, node: _Open, at) -> str:
        left, right = node.children
        return f"CASE WHEN {_binned_left(node.split, self.reads)} THEN {at(left)} ELSE {at(right)} END"

    def route(self, wanted: set[int], column: str | None = None) -> str:
        """SQL giving the explored node a row is in, or null when it is not wanted."""

        def leads(node: _Open) -> bool:
            return node.id in wanted or (node.children is not None and any(leads(c) for c in node.children))

        def at(node: _Open) -> str:
            if node.id in wanted:
                return str(node.id)
            return self._side(node, at) if leads(node) else "CAST(NULL AS INT)"

        return self._descend(column, at)

    def asked(self, wanted: set[int], held: set[int] | None = None) -> Asked:
        """The ways to the wanted nodes from those that rows in blocks are kept at, as numpy walks them."""
        nodes = tuple(sorted(wanted))
        ways = self.ways({n: i for i, n in enumerate(nodes)}, held)
        return Asked(self.slot, ways.get(self.root.id), nodes, ways)

    def ways(self, place: dict[int, int], held: set[int] | None = None) -> dict[int, Step | int]:
        """From each node that rows are kept at (else the root), the way to the places below it."""

        def at(node: _Open) -> Step | int | None:
            if node.id in place:
                return place[node.id]
            left, right = [at(c) for c in node.children] if node.children else (None, None)
            if left is None and right is None:
                return None
            return self._step(node, left, right)

        ways = {n.id: at(n) for n in self.all if n.id in (held or {self.root.id})}
        return {n: way for n, way in ways.items() if way is not None}

    def covers(self, held: set[int], wanted: set[int]) -> bool:
        """Whether the wanted nodes all lie at or below those that rows are kept at."""

        def below(node: _Open) -> set[int]:
            return {node.id}.union(*[below(c) for c in node.children or ()])

        return wanted <= set().union(*[below(n) for n in self.all if n.id in held])

    def _step(self, node: _Open, left: Step | int | None, right: Step | int | None) -> Step:
        s = node.split
        cats = tuple(s.cat_bins) if s.kind == "categorical" else None
        return Step(self.index[s.feature], s.bin, s.missing_bin, s.default_left, cats, left, right)

    def leaf_way(self) -> Step | int:
        """The way of every row to its leaf of the finished tree."""
        leaves = {n.id for n in self.chosen()[1]}

        def at(node: _Open) -> Step | int:
            return self.place[node.id] if node.id in leaves else self._step(node, *[at(c) for c in node.children])

        return at(self.root)

    def settle(self, column: str) -> str:
        """SQL giving the deepest known node of a row, which is then where rows are kept."""

        def at(node: _Open) -> str:
            return str(node.id) if node.children is None else self._side(node, at)

        text = self._descend(column, at)
        self.stored = {n.id for n in self.all if n.children is None}
        return text

    def final_leaf(self, column: str | None = None) -> str:
        """SQL giving a row's leaf of the finished tree."""
        above: dict[int, str] = {}

        def at(node: _Open) -> str:
            return str(self.place[node.id]) if node.id in leaves else self._side(node, at)

        def mark(node: _Open, leaf: str | None) -> None:
            leaf = str(self.place[node.id]) if node.id in leaves else leaf
            if leaf is not None:
                above[node.id] = leaf
            for c in node.children or ():
                mark(c, leaf)

        leaves = {n.id for n in self.chosen()[1]}
        mark(self.root, None)
        return self._descend(column, lambda n: above.get(n.id) or at(n))

    def allowed(self, node: _Open) -> list[int]:
        names = [s.name for s in self.specs]
        pool = set(self.features)
        if self.p.interaction_constraints:
            fits = [set(c) for c in self.p.interaction_constraints if set(node.branch) <= set(c)]
            pool &= set().union(*fits) if fits else set()
        if self.p.feature_fraction_bynode < 1.0:
            from paddock.operators.sampling import feature_sample

            ordered = [f for f in names if f in pool]
            if ordered:
                pool = set(feature_sample(ordered, self.p.feature_fraction_bynode, self.p.feature_fraction_seed, self.slot, node.id))
        return [i for i, f in enumerate(names) if f in pool]

    def learn(self, node: _Open, row, scale: tuple[float, float]) -> None:
        node.known = True
        if row is None:
            return
        spec = self.specs[row["feature"]]
        lg, lh, ln = row["lg"] / scale[0], row["lh"] / scale[1], row["ln"]
        tg, th, tn = row["tg"] / scale[0], row["th"] / scale[1], row["tn"]
        if node is self.root:
            node.g, node.h, node.n = tg, th, tn
            node.value = plain_output(tg, th, self.p)
        n = Node(
            spec.name,
            spec.bounds[row["bin"]] if spec.kind == "numeric" else 0.0,
            row["bin"], spec.kind, missing_type=spec.missing_type if spec.kind == "numeric" else "none",
            missing_bin=spec.missing_bin, default_left=bool(row["default_left"]), gain=row["gain"], value=node.value,
            weight=th, count=tn,
        )
        if spec.kind == "categorical":
            n.cat_bins = sorted(row["cats"])
            n.cats = [spec.categories[b - 1] for b in n.cat_bins]
        n.__dict__["sums"] = ((lg, lh, ln), (tg - lg, th - lh, tn - ln))
        n.__dict__["outputs"] = (row["lw"], row["rw"])
        node.split = n

    def finished(self) -> Tree:
        """Numbered as in one-at-a-time growth: the k-th split makes node k; its left side
        keeps the leaf's number and its right side gets the next one."""
        splits, leaves, _ = self.chosen()
        tree = Tree([], [Leaf()])
        place = {self.root.id: 0}
        parent: dict[int, tuple[int, str]] = {}
        self.used.update(s.split.feature for s in splits)
        for k, node in enumerate(splits):
            leaf, fresh = place[node.id], len(tree.leaves)
            made = Node(**{f: getattr(node.split, f) for f in Node.__dataclass_fields__})
            made.left, made.right = -1 - leaf, -1 - fresh
            if leaf in parent:
                up, side = parent[leaf]
                setattr(tree.nodes[up], side, k)
            tree.nodes.append(made)
            tree.leaves.append(Leaf())
            parent[leaf], parent[fresh] = (k, "left"), (k, "right")
            place[node.children[0].id], place[node.children[1].id] = leaf, fresh
        self.place = place
        for node in leaves:
            tree.leaves[place[node.id]] = Leaf(node.value, node.h, node.n, node.depth)
        return tree


# Rows under the nodes of a level from which the larger child of each split is derived from
# its parent instead of being summed again. Rows in blocks are summed sooner than joined.
SUBTRACT_ROWS = 2_000_000
SUBTRACT_PACKED_ROWS = 50_000_000


class _Histograms:
    """Histograms of the levels so far, kept for the parents they belong to.

    They are small (nodes x features x bins). When both children of a node are asked for,
    only the one with fewer rows is summed; the other is parent less sibling.
    """

    def __init__(self, keys: list[str], threshold: int):
        self.keys, self.threshold = keys, threshold
        self.levels: list[DataFrame] = []
        self.home: dict[tuple[int, int], int] = {}

    def plan(self, trees: list[_Growing], asked: dict[int, list[_Open]]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(slot, larger child) to (parent, smaller child, level of the parent's histogram)."""
        pairs = {}
        for t in trees:
            wanted = {n.id for n in asked[t.slot]}
            for parent in t.all:
                level = self.home.get((t.slot, parent.id))
                if level is None or parent.children is None or parent.n < self.threshold:
                    continue
                small, large = sorted(parent.children, key=lambda c: c.n)
                if {small.id, large.id} <= wanted:
                    pairs[t.slot, large.id] = (parent.id, small.id, level)
        return pairs

    def complete(self, summed: DataFrame, pairs: dict[tuple[int, int], tuple[int, int, int]]) -> DataFrame:
        """Histograms of the summed nodes and of those derived from their parents."""
        if not pairs:
            return summed
        summed = summed.persist(StorageLevel.MEMORY_AND_DISK)
        self.levels.append(summed)
        parts = []
        for level in sorted({p[2] for p in pairs.values()}):
            own = {k: p for k, p in pairs.items() if p[2] == level}
            parent = self._renamed(self.levels[level], {(slot, p[0]): large for (slot, large), p in own.items()})
            small = self._renamed(summed, {(slot, p[1]): large for (slot, large), p in own.items()})
            parts.append(histogram_subtract(parent, small, self.keys))
        for part in parts:
            summed = summed.unionByName(part)
        return summed

    def _renamed(self, hist: DataFrame, new: dict[tuple[int, int], int]) -> DataFrame:
        cases = " ".join(f"WHEN slot = {slot} AND node = {old} THEN {fresh}" for (slot, old), fresh in new.items())
        named = hist.selectExpr("slot", f"CASE {cases} END AS node", "feature", "bin", "g", "h", "n")
        return named.where("node IS NOT NULL")

    def keep(self, hist: DataFrame, asked: dict[int, list[_Open]]) -> DataFrame:
        """Remember a level for its children, when any of them could gain from it."""
        if not any(n.n >= self.threshold for nodes in asked.values() for n in nodes):
            return hist
        hist = hist.persist(StorageLevel.MEMORY_AND_DISK)
        for slot, nodes in asked.items():
            for n in nodes:
                self.home[slot, n.id] = len(self.levels)
        self.levels.append(hist)
        return hist

    def drop(self) -> None:
        for level in self.levels:
            level.unpersist()


def grow_trees(
    rows: DataFrame, slots: list[tuple[str, str]], roots: list[tuple[float, float, int]], specs: list[FeatureBins],
    p: TreeParams, scale: tuple[float, float], features: list[list[str]] | None = None, used: set[str] | None = None,
    seed: int = 0, subtract_rows: int | None = None, kept: RoundRows | RoundBlocks | None = None,
) -> list[Tree] | tuple[list[Tree], list[_Growing]]:
    """Grow one tree per slot, all levels of all slots together.

    `rows` has `bins` and, per slot, bigint gradient and hessian columns (null leaves a row
    out of that tree). Jobs are about the depth of the deepest tree, not the leaf count. With
    `kept` rows, each level goes on from the nodes stored there, and the growth of each tree is
    returned too, for the leaf of every row.
    """
    names = [s.name for s in specs]
    used = set() if used is None else used
    trees = [_Growing(i, roots[i], specs, p, (features or [names] * len(slots))[i], used) for i in range(len(slots))]
    keys = ["slot", "node"]
    special = bool(
        p.monotone_constraints or p.path_smooth > 0 or p.interaction_constraints or p.feature_fraction_bynode < 1.0
        or (features and any(set(f) != set(names) for f in features)) or p.monotone_penalty > 0
    )
    spark = rows.sparkSession
    blocks = None if kept is None else kept.blocks
    if subtract_rows is None:
        subtract_rows = SUBTRACT_ROWS if blocks is None else SUBTRACT_PACKED_ROWS
    levels = _Histograms(keys, subtract_rows)
    zero_bins = None
    if any(s.sparse for s in specs):
        zero_bins = spark.createDataFrame([(i, s.default_bin) for i, s in enumerate(specs)], "feature int, zero int")
    # Without blocks, rows go on from the nodes they are stored at.
    stands = (lambda slot: None) if kept is None or blocks is not None else kept.node
    while True:
        asked = {t.slot: t.chosen()[2] for t in trees}
        if not any(asked.values()):
            break
        if any(n.script for nodes in asked.values() for n in nodes):
            _force(trees, asked, rows if kept is None else kept.rows, slots, scale, stands, blocks, kept is not None and kept.home.wide)
        asked = {k: [n for n in v if not n.known] for k, v in asked.items()}
        if not any(asked.values()):
            continue
        derived = {} if special else levels.plan(trees, asked)
        summed = {t.slot: {n.id for n in asked[t.slot] if (t.slot, n.id) not in derived} for t in trees if asked[t.slot]}
        common = sorted({i for t in trees for n in asked[t.slot] for i in t.allowed(n)}) if special else list(range(len(names)))
        if blocks is not None and sum(map(len, summed.values())) * sum(specs[i].num_bins for i in common) <= TASK_SUMS:
            part = kept.packed.part(trees, summed)
            ways = [t.asked(summed[t.slot], part.held[t.slot]) for t in trees if t.slot in summed]
            hist = histograms(part.blocks, len(slots), specs, kept.home.wide, ways, common)
        else:
            met = rows if kept is None else kept.rows
            hist = _row_histogram(met, trees, slots, summed, stands, keys, common if len(common) < len(names) else None, zero_bins)
        nodes = None
        if not special:
            hist = levels.keep(levels.complete(hist, derived), asked)
        if special:
            table = [
                (t.slot, n.id, n.lo, n.hi, n.value, n.depth, t.allowed(n)) for t in trees for n in asked[t.slot]
            ]
            nodes = spark.createDataFrame(
                table, "slot int, node int, lo double, hi double, parent_value double, depth int, allowed array<int>"
            )
        cuts = split_gain(hist, keys, specs, p, scale, nodes)
        if any(s.kind == "categorical" for s in specs):
            cuts = cuts.unionByName(categorical_split(hist, keys, specs, p, scale, nodes))
        if special:
            cuts = cuts.where(F.array_contains("allowed", F.col("feature")))
        if p.extra_trees:
            cuts = random_cut(cuts, keys, p.extra_seed + seed)
        cuts = adjust_gain(cuts, specs, p, frozenset(used | _taken(trees)))
        found = _winners(cuts, keys, p, len(specs))
        for t in trees:
            for n in asked[t.slot]:
                t.learn(n, found.get((t.slot, n.id)), scale)
        if kept is not None:
            kept.level_done(trees)
    levels.drop()
    done = [t.finished() for t in trees]
    return done if kept is None else (done, trees)


def _row_histogram(
    rows: DataFrame, trees: list[_Growing], slots: list[tuple[str, str]], summed: dict[int, set[int]], stands, keys: list[str],
    wanted: list[int] | None, zero_bins: DataFrame | None,
) -> DataFrame:
    """The histograms of a level from rows that are not packed: sparse ones, or more sums than a task should hold."""
    cells = []
    for t in trees:
        if t.slot in summed:
            g, h = slots[t.slot]
            node = F.expr(t.route(summed[t.slot], stands(t.slot)))
            cells.append(F.struct(F.lit(t.slot).alias("slot"), node.alias("node"), F.col(g).alias("g"), F.col(h).alias("h")))
    if len(cells) == 1:
        cut = rows.select(cells[0].alias("c"), "bins").select("c.*", "bins")
    else:
        cut = rows.select(F.explode(F.array(*cells)).alias("c"), "bins").select("c.*", "bins")
    cut = cut.where(F.col("node").isNotNull() & F.col("g").isNotNull())
    return gradient_histogram(cut, keys, wanted) if zero_bins is None else sparse_histogram(cut, keys, zero_bins)


# Features up to which the per-feature winners, at most this many rows per open node, are
# compared on the driver instead of by one more shuffle.
DRIVER_FEATURES = 256


def _winners(cuts: DataFrame, keys: list[str], p: TreeParams, features: int) -> dict:
    """Best split by (slot, node). Winners per feature need no shuffle: the windows before
    have already put a node's bins of one feature together."""
    if features > DRIVER_FEATURES:
        return {tuple(r[k] for k in keys): r for r in best_split(cuts, keys, p).collect()}  # one row per open node
    top = _Steps(cuts).selectExpr("*", f"max(gain) OVER (PARTITION BY {', '.join(keys)}, feature) AS top")
    top = top.where(f"gain = top AND top > {p.min_gain_to_split!r}D").done()
    found: dict = {}
    for r in top.collect():
        at = tuple(r[k] for k in keys)
        rank = (-r["gain"], r["feature"], r["bin"], r["default_left"], len(r["cats"]))
        if at not in found or rank < found[at][0]:
            found[at] = (rank, r)
    return {k: r for k, (_, r) in found.items()}


def _taken(trees: list[_Growing]) -> set[str]:
    return {s.split.feature for t in trees if t.ordered for s in t.chosen()[0]}


def _force(
    trees: list[_Growing], asked: dict[int, list[_Open]], rows: DataFrame, slots, scale: tuple[float, float], stands,
    blocks: DataFrame | None = None, wide: bool = False,
) -> None:
    """Give scripted nodes their forced split, unless it leaves a side empty or worsens the gain.

    Rows in blocks are summed per bin of the split's feature first."""
    for t in trees:
        for n in asked[t.slot]:
            if not n.script or "feature" not in n.script or n.script.get("done"):
                continue
            at = next((i for i, s in enumerate(t.specs) if s.name == n.script["feature"]), None)
            if at is None:
                n.script = None
                continue
            spec = t.specs[at]
            g, h = slots[t.slot]
            if spec.kind == "categorical":
                b = spec.categories.index(n.script["threshold"]) + 1 if n.script["threshold"] in spec.categories else -1
                left, cats = f"{{bin}} = {b}", [b]
            else:
                b = min(sum(1 for x in spec.bounds if x < n.script["threshold"]), len(spec.bounds) - 1)
                left, cats = f"{{bin}} <= {b} AND {{bin}} <> {spec.missing_bin}", []
            if blocks is None:
                inside = rows.where((F.expr(t.route({n.id}, stands(t.slot))) == n.id) & F.col(g).isNotNull())
                inside = inside.select(F.expr(left.format(bin=t.reads[spec.name])).alias("is_left"), F.col(g).alias("g"), F.col(h).alias("h"), F.lit(1).alias("n"))
            else:
                inside = histograms(blocks, len(slots), t.specs, wide, [t.asked({n.id})], [at])
                inside = inside.select(F.expr(left.format(bin="bin")).alias("is_left"), "g", "h", "n")
            s = inside.agg(
                *[F.sum(F.when(F.col("is_left"), F.col(c)).otherwise(0)).alias(f"l{c}") for c in "ghn"], *[F.sum(c).alias(f"t{c}") for c in "ghn"]
            ).first()
            if not s["ln"] or s["ln"] == s["tn"]:
                n.script = None
                continue
            parts = [(s["lg"], s["lh"]), (s["tg"] - s["lg"], s["th"] - s["lh"]), (s["tg"], s["th"])]
            real = [(a / scale[0], b2 / scale[1]) for a, b2 in parts]
            outs = [plain_output(a, b2, t.p) for a, b2 in real]
            gains = [-(2 * a * w + (b2 + t.p.lambda_l2) * w * w) for (a, b2), w in zip(real, outs)]
            gain = gains[0] + gains[1] - gains[2]
            if gain < 0:
                n.script = None
                continue
            t.learn(
                n,
                dict(feature=at, bin=b, default_left=False, cats=cats, gain=gain, lg=s["lg"], lh=s["lh"], ln=s["ln"],
                     tg=s["tg"], th=s["th"], tn=s["tn"], lw=outs[0], rw=outs[1]),
                scale,
            )
