"""Binning, histogram, split, training, scoring, model-table, sampling and stream queries."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paddock.functions.numeric import fixed_point, sigmoid, to_places
from paddock.operators import binning as B
from paddock.operators import columns, leaves, metrics, model, sampling, scoring, sparse, training, trees
from paddock.operators.contrib import predict_contrib, predict_sparse
from paddock.operators.model import Leaf, Model, Node, Tree
from paddock.operators.objectives import ObjectiveParams, lambdarank_gradients
from paddock.operators.position_bias import PositionFactors
from paddock.plans.catalog import query, sql6, table
from paddock.plans.learning_queries import LINES_SQL, events, lines, position_step_sql, positioned
from paddock.session import shared_folder
from paddock.sources import tables
from paddock.streaming import streams

_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ROW_SQL = ", ".join(_ROW)


def _scratch(spark) -> str:
    """A new folder on shared storage for a query that writes and reads back."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# --- bins ---


def _long(spark, sf, names, hole=False):
    li = table(spark, sf, "lineitem")
    if hole:
        li = li.select(*[F.when(F.col("l_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in names])
    return columns.unpivot(li, names)


def _bins_sql(feature: str, max_bin: int, forced: tuple[float, ...] = ()) -> str:
    zone = " + ".join(f"CASE WHEN value > {b!r} THEN 1 ELSE 0 END" for b in forced) or "0"
    at = "CASE " + " ".join(f"WHEN nz = {i + 1} THEN {b!r}::DOUBLE" for i, b in enumerate(forced)) + " END" if forced else "NULL"
    return f"""(WITH v AS (SELECT CASE WHEN abs({feature}) <= 1e-35 THEN 0e0 ELSE {feature} END AS value, count(*) AS n FROM lineitem GROUP BY 1),
      s AS (SELECT sum(n) AS total, count(*) AS d FROM v),
      u AS (SELECT value, n, total, d, sum(n) OVER (ORDER BY value) AS upto, row_number() OVER (ORDER BY value) AS place FROM v, s),
      k AS (SELECT value, n, {zone} AS zone, CASE WHEN d <= {max_bin} THEN place
                 ELSE CAST(floor((upto - n) * least({max_bin} - 3, floor(total / 3)) / total) AS BIGINT) END AS slot, sign(value) AS side FROM u),
      g AS (SELECT zone, min(value) AS lo, max(value) AS hi, sum(n) AS n FROM k GROUP BY zone, side, slot),
      o AS (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS bin, lead(lo) OVER (ORDER BY lo) AS nl, lead(zone) OVER (ORDER BY lo) AS nz FROM g)
     SELECT '{feature}' AS feature, 'numeric' AS kind, CAST(bin AS INTEGER) AS bin,
       CASE WHEN nl IS NULL THEN 'Infinity'::DOUBLE WHEN nz > zone THEN {at}
            WHEN hi = 0 THEN 1e-35 ELSE nextafter((hi + nl) / 2, 'Infinity'::DOUBLE) END AS upper_bound,
       'none' AS missing_type, CAST(n AS BIGINT) AS rows FROM o)"""


def _shown_bins(df):
    return df.select("feature", "kind", "bin", "upper_bound", "missing_type", "rows")


@query(
    "find_numeric_bins",
    " UNION ALL ".join(f"SELECT * FROM {_bins_sql(c, 64)}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def _find_numeric_bins(spark, sf):
    long = _long(spark, sf, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _shown_bins(B.find_numeric_bins(long, max_bin=64))


@query(
    "max_bin_by_feature",
    " UNION ALL ".join(f"SELECT * FROM {_bins_sql(c, m)}" for c, m in (("l_quantity", 64), ("l_extendedprice", 16))),
)
def _max_bin_by_feature(spark, sf):
    long = _long(spark, sf, ["l_quantity", "l_extendedprice"])
    return _shown_bins(B.find_numeric_bins(long, max_bin=64, max_bin_by_feature={"l_extendedprice": 16}))


@query("forced_bins", f"SELECT * FROM {_bins_sql('l_extendedprice', 32, (20000.0, 50000.0))}")
def _forced_bins(spark, sf):
    # Bounds as a caller's JSON gives them, one array per feature.
    text = table(spark, sf, "lineitem").agg(F.lit('[{"feature": "l_extendedprice", "bin_upper_bound": [20000.0, 50000.0]}]').alias("j"))
    parsed = F.from_json("j", "array<struct<feature:string,bin_upper_bound:array<double>>>")
    forced = text.select(F.inline(parsed)).select("feature", F.explode("bin_upper_bound").alias("upper_bound"))
    return _shown_bins(B.find_numeric_bins(_long(spark, sf, ["l_extendedprice"]), max_bin=32, forced=forced))


@query(
    "use_missing",
    """SELECT DISTINCT 'l_quantity' AS feature, 'nan' AS missing_type FROM lineitem WHERE l_partkey % 7 = 0
       UNION ALL SELECT DISTINCT 'l_tax', 'nan' FROM lineitem WHERE l_partkey % 7 = 0""",
)
def _use_missing(spark, sf):
    return B.missing_types(_long(spark, sf, ["l_quantity", "l_tax"], hole=True))


@query("zero_as_missing", "SELECT DISTINCT 'l_discount' AS feature, 'zero' AS missing_type FROM lineitem")
def _zero_as_missing(spark, sf):
    return B.missing_types(_long(spark, sf, ["l_discount"]), zero_as_missing=True)


@query(
    "bins_with_missing",
    """SELECT 'l_tax' AS feature, CAST(rank() OVER (ORDER BY v) - 1 AS INTEGER) AS bin, n AS rows, 'nan' AS missing_type FROM
       (SELECT CASE WHEN l_partkey % 7 = 0 THEN 1e9 ELSE l_tax + 0e0 END AS v, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def _bins_with_missing(spark, sf):
    return B.find_numeric_bins(_long(spark, sf, ["l_tax"], hole=True)).select("feature", "bin", "rows", "missing_type")


_SPECS = [
    B.FeatureBins("l_quantity", bounds=[5.0, 10.0, 25.0, 40.0, float("inf")], missing_type="nan"),
    B.FeatureBins("l_discount", bounds=[1e-35, 0.03, 0.055, float("inf")], missing_type="zero"),
    B.FeatureBins("l_tax", bounds=[0.02, 0.05, float("inf")]),
    B.FeatureBins("l_linenumber", "categorical", categories=[3, 1, 5]),
]
_HOLE_SQL = f"""(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q,
   CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount + 0e0 END AS d, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_tax + 0e0 END AS t FROM lineitem)"""
_BIN_SQL = {
    "l_quantity": "CAST(CASE WHEN q IS NULL THEN 5 WHEN q <= 5 THEN 0 WHEN q <= 10 THEN 1 WHEN q <= 25 THEN 2 WHEN q <= 40 THEN 3 ELSE 4 END AS INTEGER)",
    "l_discount": "CAST(CASE WHEN coalesce(d, 0) <= 1e-35 THEN 0 WHEN d <= 3e-2 THEN 1 WHEN d <= 55e-3 THEN 2 ELSE 3 END AS INTEGER)",
    "l_tax": "CAST(CASE WHEN coalesce(t, 0) <= 2e-2 THEN 0 WHEN t <= 5e-2 THEN 1 ELSE 2 END AS INTEGER)",
    "l_linenumber": "CAST(CASE l_linenumber WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS INTEGER)",
}


def holed(spark, sf):
    """Line items whose features have missing values."""
    li = table(spark, sf, "lineitem")
    hole = lambda c, m: F.when(F.col("l_partkey") % m != 0, F.col(c)).alias(c)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", hole("l_quantity", 7),
        hole("l_discount", 11), hole("l_tax", 13), (F.col("l_returnflag") == "R").cast("double").alias("label"),
    )


@query("value_to_bin", f"SELECT {_ROW_SQL}, {_BIN_SQL['l_quantity']} AS bin FROM {_HOLE_SQL}")
def _value_to_bin(spark, sf):
    return holed(spark, sf).select(*_ROW, B.value_to_bin(F.col("l_quantity"), _SPECS[0]).cast("int").alias("bin"))


@query("bin_table", f"SELECT l_orderkey, l_partkey, l_suppkey, {', '.join(f'{e} AS {c}' for c, e in _BIN_SQL.items())} FROM {_HOLE_SQL}")
def _bin_table(spark, sf):
    return B.bin_table(holed(spark, sf), _SPECS, ["l_orderkey", "l_partkey", "l_suppkey"])


@query(
    "bin_to_value",
    f"""SELECT {_ROW_SQL}, CASE {_BIN_SQL['l_tax']} WHEN 0 THEN 2e-2 WHEN 1 THEN 5e-2 ELSE 'Infinity'::DOUBLE END AS value FROM {_HOLE_SQL}""",
)
def _bin_to_value(spark, sf):
    binned = holed(spark, sf).select(*_ROW, F.lit("l_tax").alias("feature"), B.value_to_bin(F.col("l_tax"), _SPECS[2]).cast("int").alias("bin"))
    rows = [("l_tax", "numeric", i, b, None, "none", 0) for i, b in enumerate(_SPECS[2].bounds)]
    return B.bin_to_value(binned, spark.createDataFrame(rows, B.SPEC_SCHEMA)).select(*_ROW, "value")


@query(
    "find_category_bins",
    """SELECT 'l_suppkey' AS feature, CAST(row_number() OVER (ORDER BY n DESC, c) AS INTEGER) AS bin, c AS category, n AS rows
       FROM (SELECT CAST(l_suppkey AS INTEGER) AS c, count(*) AS n FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1) QUALIFY bin < 64""",
)
def _find_category_bins(spark, sf):
    return B.find_category_bins(_long(spark, sf, ["l_suppkey"], hole=True), 64)


@query(
    "bin_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS num_bins, CAST(arg_max(b, n * 1000 - b) AS INTEGER) AS most_freq_bin, "
        f"{sql6(f'sum(CASE WHEN b = {z} THEN n ELSE 0 END) * 1e0 / sum(n)')} AS sparse_rate FROM (SELECT {e} AS b, count(*) AS n FROM {_HOLE_SQL} GROUP BY 1)"
        for (c, e), z in zip(_BIN_SQL.items(), (0, 0, 0, 0))
    ),
)
def _bin_stats(spark, sf):
    binned = B.bin_table(holed(spark, sf), _SPECS)
    return B.bin_stats(binned, list(_BIN_SQL)).withColumn("sparse_rate", to_places(F.col("sparse_rate")))


@query("category_bitset", f"SELECT {_ROW_SQL}, l_suppkey IN (3, 17, 40) AS member FROM lineitem")
def _category_bitset(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*_ROW, B.category_bitset(F.col("l_suppkey") + 0.25, [3, 17, 40]).alias("member"))


@query("align_to_bins", f"SELECT l_orderkey, l_partkey, l_suppkey, {_BIN_SQL['l_tax']} AS l_tax, 0 AS misaligned FROM {_HOLE_SQL}")
def _align_to_bins(spark, sf):
    found = B.find_numeric_bins(_long(spark, sf, ["l_discount"]), max_bin=16)
    same = B.check_aligned(found, B.find_numeric_bins(_long(spark, sf, ["l_discount"]), max_bin=16)).count()
    rows = B.bin_table(holed(spark, sf), [_SPECS[2]], ["l_orderkey", "l_partkey", "l_suppkey"])
    return rows.withColumn("misaligned", F.lit(same).cast("int"))


_PACKED_SQL = " || ',' || ".join(f"CAST({e} AS VARCHAR)" for e in _BIN_SQL.values())


def _as_text(df):
    return df.withColumn("bins", F.array_join(F.transform("bins", lambda b: b.cast("string")), ","))


@query("save_binned", f"SELECT l_partkey AS row_id, {_PACKED_SQL} AS bins FROM {_HOLE_SQL}")
def _save_binned(spark, sf):
    path = _scratch(spark)
    df = holed(spark, sf).withColumn("row_id", F.col("l_partkey")).withColumn("init_score", F.lit(1.0))
    rows = [(s.name, s.kind, i, b, None, s.missing_type, 0) for s in _SPECS for i, b in enumerate(s.bounds)]
    rows += [("l_linenumber", "categorical", i, None, c, "none", 0) for i, c in enumerate(_SPECS[3].categories, 1)]
    tables.save_binned(B.bin_table(df, _SPECS, ["row_id", "init_score"], packed=True), spark.createDataFrame(rows, B.SPEC_SCHEMA), path)
    binned, specs = tables.load_binned(spark, path)
    assert {s.name: (s.bounds, s.categories) for s in specs} == {s.name: (s.bounds, s.categories) for s in _SPECS}
    return _as_text(binned)


@query("push_block", f"SELECT l_partkey AS row_id, {_PACKED_SQL} AS bins FROM {_HOLE_SQL}")
def _push_block(spark, sf):
    path = _scratch(spark)
    df = holed(spark, sf).withColumn("row_id", F.col("l_partkey"))
    for part in (0, 1, 0):  # the first block comes twice
        tables.push_block(df.where(F.col("l_suppkey") % 2 == part), _SPECS, path, part)
    tables.finish_blocks(spark, path, 2)
    return _as_text(tables.load_blocks(spark, path).drop("label"))


# --- histograms and splits ---

_SCALE = 2.0**20


def graded(spark, sf):
    """Bins, one leaf per two line numbers, and fixed-point binary gradients at a fixed score."""
    df = lines(spark, sf)
    p = sigmoid(F.col("score"))
    bins = F.array(
        F.floor((F.col("l_quantity") - 1) / 10.0).cast("int"), F.floor(F.col("l_discount") * 100.0 + 0.5).cast("int"),
        F.floor(F.col("l_tax") * 100.0 + 0.5).cast("int"), (F.col("l_suppkey") % 12).cast("int"),
    )
    return df.select(
        *_ROW, "l_extendedprice", (F.col("l_linenumber") % 2).cast("int").alias("leaf"), bins.alias("bins"), "y_reg", "score",
        fixed_point(p - F.col("y_bin"), _SCALE).alias("g"), fixed_point(p * (1.0 - p), _SCALE).alias("h"),
    )


_GRADED_SQL = f"""(SELECT *, CAST(l_linenumber % 2 AS INTEGER) AS leaf, CAST(floor((l_quantity - 1) / 1e1) AS INTEGER) AS b0,
   CAST(floor(l_discount * 1e2 + 5e-1) AS INTEGER) AS b1, CAST(floor(l_tax * 1e2 + 5e-1) AS INTEGER) AS b2, CAST(l_suppkey % 12 AS INTEGER) AS b3,
   CAST(floor((1e0 / (1e0 + exp(-s)) - y_bin) * 1048576e0 + 5e-1) AS BIGINT) AS g,
   CAST(floor((1e0 / (1e0 + exp(-s))) * (1e0 - 1e0 / (1e0 + exp(-s))) * 1048576e0 + 5e-1) AS BIGINT) AS h FROM {LINES_SQL})"""


def _hist_sql(features, where="TRUE"):
    return "(" + " UNION ALL ".join(
        f"SELECT leaf, CAST({i} AS INTEGER) AS feature, b{i} AS bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n "
        f"FROM {_GRADED_SQL} WHERE {where} GROUP BY leaf, b{i}" for i in features
    ) + ")"


@query("gradient_histogram", f"SELECT * FROM {_hist_sql(range(4))}")
def _gradient_histogram(spark, sf):
    return trees.gradient_histogram(graded(spark, sf), ["leaf"])


@query("histogram_merge", f"SELECT * FROM {_hist_sql(range(4))}")
def _histogram_merge(spark, sf):
    rows = graded(spark, sf)
    parts = [trees.gradient_histogram(rows.where(F.col("l_suppkey") % 3 == i), ["leaf"]) for i in range(3)]
    return trees.histogram_merge(parts, ["leaf"])


@query("histogram_subtract", f"SELECT * FROM {_hist_sql(range(4), 'l_suppkey % 3 <> 0')}")
def _histogram_subtract(spark, sf):
    rows = graded(spark, sf)
    parent = trees.gradient_histogram(rows, ["leaf"])
    return trees.histogram_subtract(parent, trees.gradient_histogram(rows.where("l_suppkey % 3 = 0"), ["leaf"]), ["leaf"])


_FLAT_SPECS = [
    B.FeatureBins("q", bounds=[float(i) for i in range(4)] + [float("inf")]),
    B.FeatureBins("d", bounds=[float(i) for i in range(11)] + [float("inf")], missing_type="nan"),
    B.FeatureBins("t", bounds=[float(i) for i in range(8)] + [float("inf")], missing_type="zero"),
    B.FeatureBins("c", "categorical", categories=list(range(11))),
]
# Feature d: no bin is missing in the data but bin 12; feature t: bin 0 takes the default side.
_CUT = trees.TreeParams(min_data_in_leaf=50, lambda_l1=0.5, lambda_l2=2.0, cat_l2=10.0, cat_smooth=10.0, min_data_per_group=100, max_cat_threshold=6)


def _gain_sql(lg, lh, rg, rh, tg, th, l2="2e0"):
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - 5e-1, 0e0))"
    part = lambda g, h, lam: f"({soft(g)} * {soft(g)} / ({h} + {lam}))"
    return f"{part(lg, lh, l2)} + {part(rg, rh, l2)} - {part(tg, th, '2e0')}"


_CUTS_SQL = f"""(WITH x AS (SELECT leaf, feature, bin, g / 1048576e0 AS g, h / 1048576e0 AS h, n,
        (feature = 2 AND bin = 0) AS lost FROM {_hist_sql(range(3))}),
     w AS (SELECT leaf, feature, bin, lost,
        sum(CASE WHEN lost THEN 0 ELSE g END) OVER a AS lg, sum(CASE WHEN lost THEN 0 ELSE h END) OVER a AS lh, sum(CASE WHEN lost THEN 0 ELSE n END) OVER a AS ln,
        sum(g) OVER b AS tg, sum(h) OVER b AS th, sum(n) OVER b AS tn,
        sum(CASE WHEN lost THEN g ELSE 0 END) OVER b AS mg, sum(CASE WHEN lost THEN h ELSE 0 END) OVER b AS mh, sum(CASE WHEN lost THEN n ELSE 0 END) OVER b AS mn
        FROM x WINDOW a AS (PARTITION BY leaf, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY leaf, feature)),
     c AS (SELECT leaf, feature, bin, false AS default_left, lg, lh, ln, tg, th, tn FROM w WHERE NOT lost
        UNION ALL SELECT leaf, feature, bin, true, lg + mg, lh + mh, ln + mn, tg, th, tn FROM w WHERE NOT lost AND mn > 0)
     SELECT leaf, feature, bin, default_left, {_gain_sql('lg', 'lh', '(tg - lg)', '(th - lh)', 'tg', 'th')} AS gain,
        CAST(ln AS BIGINT) AS ln, CAST(tn AS BIGINT) AS tn FROM c WHERE ln >= 50 AND tn - ln >= 50 AND lh >= 1e-3 AND th - lh >= 1e-3)"""


@query("split_gain", f"SELECT leaf, feature, bin, default_left, {sql6('gain')} AS gain, ln FROM {_CUTS_SQL}")
def _split_gain(spark, sf):
    cuts = trees.split_gain(trees.gradient_histogram(graded(spark, sf), ["leaf"]), ["leaf"], _FLAT_SPECS, _CUT, (_SCALE, _SCALE))
    return cuts.select("leaf", "feature", "bin", "default_left", to_places(F.col("gain")).alias("gain"), "ln")


@query(
    "best_split",
    f"""SELECT leaf, feature, bin, default_left, {sql6('gain')} AS gain, ln FROM {_CUTS_SQL} WHERE gain > 0
        QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, feature, bin, default_left) = 1""",
)
def _best_split(spark, sf):
    cuts = trees.split_gain(trees.gradient_histogram(graded(spark, sf), ["leaf"]), ["leaf"], _FLAT_SPECS, _CUT, (_SCALE, _SCALE))
    best = trees.best_split(cuts, ["leaf"], _CUT)
    return best.select("leaf", "feature", "bin", "default_left", to_places(F.col("gain")).alias("gain"), "ln")


@query(
    "feature_contri",
    f"""SELECT leaf, feature, bin, default_left, {sql6("gain * CASE feature WHEN 0 THEN 5e-1 WHEN 1 THEN 0e0 ELSE 2e0 END - 1e-3 * tn - CASE feature WHEN 2 THEN 3e0 ELSE 0e0 END")} AS gain FROM {_CUTS_SQL}""",
)
def _feature_contri(spark, sf):
    p = trees.TreeParams(
        **{**_CUT.__dict__, "feature_contri": {"q": 0.5, "d": -1.0, "t": 2.0}, "cegb_penalty_split": 0.001,
           "cegb_penalty_feature_coupled": {"t": 3.0}}
    )
    cuts = trees.split_gain(trees.gradient_histogram(graded(spark, sf), ["leaf"]), ["leaf"], _FLAT_SPECS, p, (_SCALE, _SCALE))
    out = trees.adjust_gain(cuts, _FLAT_SPECS, p)
    return out.select("leaf", "feature", "bin", "default_left", to_places(F.col("gain")).alias("gain"))


def _prefix_sql(direction):
    return f"""SELECT leaf, string_agg(CAST(bin AS VARCHAR), ',' ORDER BY bin) AS cats, any_value(ln) AS ln, any_value(gain) AS gain FROM
      (SELECT a.leaf, a.place, b.bin, a.ln, a.gain FROM
       (SELECT *, {_gain_sql('lg', 'lh', '(tg - lg)', '(th - lh)', 'tg', 'th', '12e0')} AS gain FROM
        (SELECT *, sum(g) OVER o AS lg, sum(h) OVER o AS lh, CAST(sum(n) OVER o AS BIGINT) AS ln, row_number() OVER (PARTITION BY leaf ORDER BY ratio {direction}, bin) AS place FROM k
         WINDOW o AS (PARTITION BY leaf ORDER BY ratio {direction}, bin ROWS UNBOUNDED PRECEDING))
        WHERE place <= 6 AND ln >= 100 AND tn - ln >= 100) a
       JOIN (SELECT leaf, bin, row_number() OVER (PARTITION BY leaf ORDER BY ratio {direction}, bin) AS place FROM k) b ON a.leaf = b.leaf AND b.place <= a.place)
      GROUP BY leaf, place"""


@query(
    "categorical_split",
    f"""WITH t AS (SELECT leaf, bin, g / 1048576e0 AS g, h / 1048576e0 AS h, n, sum(g) OVER w / 1048576e0 AS tg, sum(h) OVER w / 1048576e0 AS th, sum(n) OVER w AS tn
               FROM {_hist_sql([3])} WINDOW w AS (PARTITION BY leaf)),
            k AS (SELECT *, g / (h + 1e1) AS ratio FROM t WHERE bin > 0)
        SELECT leaf, cats, CAST(ln AS BIGINT) AS ln, {sql6('gain')} AS gain FROM ({_prefix_sql('ASC')} UNION ALL {_prefix_sql('DESC')})""",
)
def _categorical_split(spark, sf):
    hist = trees.gradient_histogram(graded(spark, sf), ["leaf"])
    cuts = trees.categorical_split(hist, ["leaf"], _FLAT_SPECS, _CUT, (_SCALE, _SCALE))
    shown = F.array_join(F.transform(F.array_sort("cats"), lambda c: c.cast("string")), ",")
    return cuts.select("leaf", shown.alias("cats"), "ln", to_places(F.col("gain")).alias("gain"))


@query("apply_split", f"SELECT {_ROW_SQL}, CAST(CASE WHEN leaf = 1 AND NOT (b2 <> 0 AND b2 <= 4) THEN 2 ELSE leaf END AS INTEGER) AS leaf FROM {_GRADED_SQL}")
def _apply_split(spark, sf):
    node = Node("t", bin=4, missing_bin=0, default_left=False)
    return trees.apply_split(graded(spark, sf), 1, 2, node, [s.name for s in _FLAT_SPECS]).select(*_ROW, "leaf")


@query(
    "leaf_values",
    f"""SELECT leaf, {sql6("greatest(least(-sign(g) * greatest(abs(g) - 5e-1, 0e0) / (h + 2e0), 3e-1), -3e-1) * 1e-1")} AS value, {sql6('h')} AS weight, n AS count
        FROM (SELECT leaf, sum(g) / 1048576e0 AS g, sum(h) / 1048576e0 AS h, count(*) AS n FROM {_GRADED_SQL} GROUP BY leaf)""",
)
def _leaf_values(spark, sf):
    p = trees.TreeParams(lambda_l1=0.5, lambda_l2=2.0, max_delta_step=0.3)
    out = trees.leaf_values(graded(spark, sf), p, 0.1, (_SCALE, _SCALE))
    return out.select("leaf", to_places(F.col("value")).alias("value"), to_places(F.col("weight")).alias("weight"), "count")


_RESIDUAL_SQL = f"""(SELECT leaf, y_reg - s AS r, 1e0 + l_suppkey % 3 AS w FROM {_GRADED_SQL})"""


@query(
    "renew_leaf_percentile",
    f"""WITH o AS (SELECT leaf, r, row_number() OVER (PARTITION BY leaf ORDER BY r DESC) AS place, count(*) OVER (PARTITION BY leaf) AS n FROM {_RESIDUAL_SQL})
        SELECT leaf, {sql6("max(CASE WHEN place = floor(3e-1 * n) THEN r END) - (max(CASE WHEN place = floor(3e-1 * n) THEN r END) - max(CASE WHEN place = floor(3e-1 * n) + 1 THEN r END)) * (any_value(3e-1 * n) - floor(any_value(3e-1 * n)))")} AS renewed
        FROM o GROUP BY leaf""",
)
def _renew_leaf(spark, sf):
    rows = graded(spark, sf).select(
        "leaf", (F.col("y_reg") - F.col("score")).alias("residual"), F.lit(1.0).alias("weight"), F.xxhash64(*_ROW, "l_extendedprice").alias("row_id")
    )
    return leaves.renew_leaf_percentile(rows, 0.7).withColumn("renewed", to_places(F.col("renewed")))


@query(
    "renew_leaf_weighted",
    f"""WITH o AS (SELECT leaf, r, w, sum(w) OVER (PARTITION BY leaf ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS reach, sum(w) OVER (PARTITION BY leaf) AS total,
                  row_number() OVER (PARTITION BY leaf ORDER BY r DESC) AS place FROM (SELECT leaf, r, sum(w) AS w FROM {_RESIDUAL_SQL} GROUP BY leaf, r)),
             f AS (SELECT leaf, min(place) AS pos FROM o WHERE reach > 5e-1 * total GROUP BY leaf)
        SELECT o.leaf, {sql6("max(CASE WHEN place = pos - 1 THEN r END) - (max(CASE WHEN place = pos - 1 THEN r END) - max(CASE WHEN place = pos THEN r END)) * (5e-1 * any_value(total) - max(CASE WHEN place = pos - 1 THEN reach END)) / (max(CASE WHEN place = pos THEN reach END) - max(CASE WHEN place = pos - 1 THEN reach END))")} AS renewed
        FROM o JOIN f ON o.leaf = f.leaf AND place BETWEEN pos - 1 AND pos GROUP BY o.leaf""",
)
def _renew_leaf_weighted(spark, sf):
    rows = graded(spark, sf).select("leaf", (F.col("y_reg") - F.col("score")).alias("residual"), (1.0 + F.col("l_suppkey") % 3).alias("weight"))
    combined = rows.groupBy("leaf", "residual").agg(F.sum("weight").alias("weight")).withColumn("row_id", F.col("residual"))
    return leaves.renew_leaf_percentile(combined, 0.5, weighted=True).withColumn("renewed", to_places(F.col("renewed")))


@query(
    "path_smoothing",
    f"""SELECT c.leaf, c.b0 AS bin, {sql6("(c.w * (c.n / 1e2) + p.w) / (c.n / 1e2 + 1e0)")} AS value FROM
        (SELECT leaf, b0, avg(g) / 1048576e0 AS w, count(*) AS n FROM {_GRADED_SQL} GROUP BY leaf, b0) c JOIN
        (SELECT leaf, avg(g) / 1048576e0 AS w FROM {_GRADED_SQL} GROUP BY leaf) p ON p.leaf = c.leaf""",
)
def _path_smoothing(spark, sf):
    rows = graded(spark, sf).withColumn("bin", F.col("bins")[0])
    child = rows.groupBy("leaf", "bin").agg((F.avg("g") / _SCALE).alias("w"), F.count(F.lit(1)).alias("n"))
    parent = rows.groupBy("leaf").agg((F.avg("g") / _SCALE).alias("pw"))
    value = trees.smoothed(F.col("w"), F.col("n"), F.col("pw"), 100.0)
    return child.join(parent, "leaf").select("leaf", "bin", to_places(value).alias("value"))


# --- scoring with a fixed model ---

FIXED_MODEL = Model(
    [
        Tree(
            [
                Node("l_quantity", 25.0, missing_type="nan", default_left=True, left=1, right=2, gain=30.0, count=100),
                Node("l_discount", 0.03, missing_type="zero", default_left=False, left=-1, right=-2, gain=20.0, count=50),
                Node("l_linenumber", 0.0, kind="categorical", cats=[1, 3, 5], left=-3, right=-4, gain=10.0, count=50),
            ],
            [Leaf(0.5, 10, 20), Leaf(-0.25, 10, 30), Leaf(0.125, 10, 25), Leaf(-1.0, 10, 25)],
            0,
        ),
        Tree([Node("l_tax", 0.05, left=-1, right=-2, gain=5.0, count=100)], [Leaf(0.75, 10, 60), Leaf(-0.5, 10, 40)], 1),
        Tree([], [Leaf(0.0625, 10, 100)], 2),
    ],
    ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
    "binary",
)
_LEAF0 = """CASE WHEN q IS NULL OR q <= 25 THEN CASE WHEN d IS NULL OR d = 0 OR d > 3e-2 THEN 1 ELSE 0 END
            WHEN l_linenumber IN (1, 3, 5) THEN 2 ELSE 3 END"""
_LEAF1 = "CASE WHEN t IS NULL OR t <= 5e-2 THEN 0 ELSE 1 END"
_V0 = f"CASE {_LEAF0} WHEN 0 THEN 5e-1 WHEN 1 THEN -25e-2 WHEN 2 THEN 125e-3 ELSE -1e0 END"
_V1 = f"CASE {_LEAF1} WHEN 0 THEN 75e-2 ELSE -5e-1 END"
_RAW_SQL = f"({_V0} + {_V1} + 625e-4)"
_PLAIN = f"{_ROW_SQL}, l_extendedprice"


def _plain(df):
    return df.select(*_ROW, "l_extendedprice", *[c for c in df.columns if c in ("raw", "prediction", "leaf0", "leaf1", "leaf2")])


@query("predict_leaf", f"SELECT {_PLAIN}, CAST({_LEAF0} AS INTEGER) AS leaf0, CAST({_LEAF1} AS INTEGER) AS leaf1, CAST(0 AS INTEGER) AS leaf2 FROM {_HOLE_SQL}")
def _predict_leaf(spark, sf):
    out = scoring.predict_leaf(holed(spark, sf), FIXED_MODEL)
    return _plain(out.select("*", *[F.col("leaves")[i].alias(f"leaf{i}") for i in range(3)]))


@query("predict_raw", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _predict_raw(spark, sf):
    return _plain(scoring.predict_raw(holed(spark, sf), FIXED_MODEL))


@query("predict_raw_large_model", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _predict_raw_walk(spark, sf):
    return _plain(scoring.predict_raw(holed(spark, sf), FIXED_MODEL, expression_nodes=0))


@query("predict", f"SELECT {_PLAIN}, {sql6(f'1e0 / (1e0 + exp(-{_RAW_SQL}))')} AS prediction FROM {_HOLE_SQL}")
def _predict(spark, sf):
    return _plain(scoring.predict(holed(spark, sf), FIXED_MODEL).withColumn("prediction", to_places(F.col("prediction"))))


@query("predict_range", f"SELECT {_PLAIN}, {_V1} AS raw FROM {_HOLE_SQL}")
def _predict_range(spark, sf):
    return _plain(scoring.predict_raw(holed(spark, sf), model.sliced(FIXED_MODEL, 1, 1)))


@query("predict_early_stop", f"SELECT {_PLAIN}, CASE WHEN 2 * abs({_V0}) > 9e-1 THEN {_V0} WHEN 2 * abs({_V0} + {_V1}) > 9e-1 THEN {_V0} + {_V1} ELSE {_RAW_SQL} END AS raw FROM {_HOLE_SQL}")
def _predict_early_stop(spark, sf):
    return _plain(scoring.predict_early_stop(holed(spark, sf), FIXED_MODEL, freq=1, margin=0.9))


@query("predict_files", f"SELECT {_PLAIN}, {sql6(f'1e0 / (1e0 + exp(-{_RAW_SQL}))')} AS prediction FROM {_HOLE_SQL}")
def _predict_files(spark, sf):
    path = _scratch(spark)
    holed(spark, sf).write.parquet(f"{path}/in")
    scoring.predict_files(spark, [f"{path}/in"], FIXED_MODEL, f"{path}/out")
    return _plain(spark.read.parquet(f"{path}/out").withColumn("prediction", to_places(F.col("prediction"))))


@query("save_scores", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _save_scores(spark, sf):
    path = _scratch(spark)
    tables.save_scores(scoring.predict_raw(holed(spark, sf), FIXED_MODEL), path, [*_ROW, "l_extendedprice", "raw"])
    return spark.read.parquet(path)


@query("predict_many_inputs", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL} UNION ALL SELECT {_PLAIN}, {_V1} + 625e-4 + CASE WHEN coalesce(q, 0) <= 25 THEN CASE WHEN coalesce(d, 0) = 0 OR d > 3e-2 THEN -25e-2 ELSE 5e-1 END WHEN l_linenumber IN (1, 3, 5) THEN 125e-3 ELSE -1e0 END FROM {_HOLE_SQL}")
def _predict_many_inputs(spark, sf):
    df = holed(spark, sf)
    halves = [df.where("l_suppkey % 2 = 0"), df.where("l_suppkey % 2 <> 0")]
    dense = _plain(scoring.predict_raw(columns.concat_matrices(halves), FIXED_MODEL))
    pairs = F.map_filter(
        F.create_map(*[x for f in FIXED_MODEL.features for x in (F.lit(f), F.col(f).cast("double"))]), lambda k, v: v.isNotNull()
    )
    mapped = df.select(*_ROW, "l_extendedprice", pairs.alias("features")).withColumnRenamed("l_linenumber", "line")
    return dense.unionByName(scoring.predict_map(mapped, FIXED_MODEL).withColumnRenamed("line", "l_linenumber").select(*dense.columns))


@query("score_by_leaf", f"SELECT l_orderkey * 1000 + l_suppkey AS row_id, sum({_RAW_SQL}) AS raw FROM {_HOLE_SQL} GROUP BY 1")
def _score_by_leaf(spark, sf):
    rows = scoring.predict_leaf(holed(spark, sf), FIXED_MODEL).withColumn("row_id", F.col("l_orderkey") * 1000 + F.col("l_suppkey"))
    return scoring.score_by_leaf(rows, model.to_tables(spark, FIXED_MODEL)[1])


@query("model_to_sql", f"SELECT {_PLAIN}, {scoring.model_to_sql(FIXED_MODEL, quote='')} AS raw FROM (SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS l_discount, CASE WHEN l_partkey % 13 <> 0 THEN l_tax END AS l_tax) FROM lineitem)")
def _model_to_sql(spark, sf):
    return _plain(holed(spark, sf).selectExpr("*", f"{scoring.model_to_sql(FIXED_MODEL)} AS raw"))


@query("predict_contrib", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _predict_contrib(spark, sf):
    """Additivity: contributions and expected value sum to the raw score of every row."""
    out = predict_contrib(holed(spark, sf), FIXED_MODEL, [*_ROW, "l_extendedprice"])
    total = F.aggregate("contrib", F.lit(0.0), lambda a, x: a + x)
    return _plain(out.withColumn("raw", to_places(total)))


@query("predict_sparse")
def _predict_sparse(spark, sf):
    return predict_sparse(predict_contrib(holed(spark, sf), FIXED_MODEL, _ROW), _ROW)


# --- model tables, rendered from line items: one tree per supplier ---


def node_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("int").alias("tree_id"), F.col("l_suppkey").cast("int").alias("iteration"), F.lit(0).alias("class_id"),
        F.col("l_orderkey").cast("int").alias("node_id"), F.col("l_returnflag").alias("feature"), F.col("l_tax").alias("threshold"),
        F.lit("numeric").alias("kind"), F.array().cast("array<int>").alias("cats"), F.lit(True).alias("default_left"),
        F.lit(-1).alias("left"), F.lit(-2).alias("right"), (F.col("l_quantity") - 10).alias("gain"),
        F.floor("l_extendedprice").cast("double").alias("value"), F.col("l_linenumber").cast("long").alias("count"),
    )


def leaf_rows(spark, sf):
    n = node_rows(spark, sf)
    return n.select("tree_id", "iteration", "class_id", F.col("node_id").alias("leaf_id"), "value", F.col("gain").alias("weight"), "count")


_NODES_SQL = """(SELECT CAST(l_suppkey AS INTEGER) AS tree_id, CAST(l_suppkey AS INTEGER) AS iteration, l_returnflag AS feature, l_quantity - 10 AS gain,
   floor(l_extendedprice) AS value, l_linenumber AS n, CAST(l_orderkey AS INTEGER) AS leaf_id FROM lineitem)"""


@query("feature_importance", f"SELECT feature, count(*) AS splits, sum(gain) AS total_gain FROM {_NODES_SQL} WHERE gain > 0 AND iteration < 50 GROUP BY feature")
def _feature_importance(spark, sf):
    return model.feature_importance(node_rows(spark, sf), 50)


@query("model_bounds", f"SELECT sum(hi) AS upper_bound, sum(lo) AS lower_bound FROM (SELECT max(value) AS hi, min(value) AS lo FROM {_NODES_SQL} GROUP BY tree_id)")
def _model_bounds(spark, sf):
    return model.model_bounds(leaf_rows(spark, sf))


@query("expected_value", f"SELECT tree_id, {sql6('sum(value * n) / sum(n)')} AS expected FROM {_NODES_SQL} GROUP BY tree_id")
def _expected_value(spark, sf):
    return model.expected_value(leaf_rows(spark, sf)).withColumn("expected", to_places(F.col("expected")))


@query("merge_models", f"SELECT tree_id, leaf_id, value FROM {_NODES_SQL} WHERE tree_id % 2 = 0 UNION ALL SELECT CAST(tree_id + (SELECT max(tree_id) + 1 FROM {_NODES_SQL} WHERE tree_id % 2 = 0) AS INTEGER), leaf_id, value FROM {_NODES_SQL} WHERE tree_id % 2 <> 0")
def _merge_models(spark, sf):
    rows = leaf_rows(spark, sf)
    return model.merge_models(rows.where("tree_id % 2 = 0"), rows.where("tree_id % 2 <> 0")).select("tree_id", "leaf_id", "value")


@query("slice_model", f"SELECT tree_id, leaf_id, value FROM {_NODES_SQL} WHERE iteration >= 20 AND iteration < 35")
def _slice_model(spark, sf):
    return model.slice_model(leaf_rows(spark, sf), 20, 15).select("tree_id", "leaf_id", "value")


@query("shrink_trees", f"SELECT tree_id, leaf_id, {sql6('value * 1e-1')} AS value FROM {_NODES_SQL}")
def _shrink_trees(spark, sf):
    return model.shrink_trees(leaf_rows(spark, sf), 0.1).select("tree_id", "leaf_id", to_places(F.col("value")).alias("value"))


@query("add_bias", f"SELECT tree_id, leaf_id, value + 25e-2 AS value FROM {_NODES_SQL}")
def _add_bias(spark, sf):
    return model.add_bias(leaf_rows(spark, sf), 0.25).select("tree_id", "leaf_id", "value")


@query(
    "refit_join",
    f"""SELECT o.tree_id, o.leaf_id, {sql6('coalesce(9e-1 * o.value + 1e-1 * n.v, o.value)')} AS value FROM {_NODES_SQL} o LEFT JOIN
        (SELECT tree_id, leaf_id, avg(gain) AS v FROM {_NODES_SQL} WHERE tree_id % 2 = 0 GROUP BY tree_id, leaf_id) n ON n.tree_id = o.tree_id AND n.leaf_id = o.leaf_id""",
)
def _refit_join(spark, sf):
    rows = leaf_rows(spark, sf)
    fresh = rows.where("tree_id % 2 = 0").groupBy("tree_id", "leaf_id").agg(F.avg("weight").alias("new_value"))
    out = model.refit_leaves(rows, fresh, 0.9)
    return out.select("tree_id", "leaf_id", to_places(F.col("value")).alias("value"))


@query("dump_model", f"SELECT tree_id, count(*) AS n_nodes FROM {_NODES_SQL} GROUP BY tree_id")
def _dump_model(spark, sf):
    dumped = model.dump_model(node_rows(spark, sf), leaf_rows(spark, sf))
    return dumped.select("tree_id", F.json_array_length(F.get_json_object("json", "$.nodes")).cast("bigint").alias("n_nodes"))


# --- sampling ---


@query("sample_for_bins", "SELECT event_id AS row_id FROM events ORDER BY substr(md5(event_id || '/1'), 1, 16), event_id LIMIT 5000")
def _sample_for_bins(spark, sf):
    return sampling.sample_for_bins(events(spark, sf), 5000).select("row_id")


@query("reservoir_sample", "SELECT event_id AS row_id FROM events WHERE event_type = 'click' ORDER BY substr(md5(event_id || '/7'), 1, 16), event_id LIMIT 300")
def _reservoir_sample(spark, sf):
    return sampling.reservoir_sample(events(spark, sf), 300, 7, F.col("label") == 1.0).select("row_id")


@query("bagging")
def _bagging(spark, sf):
    return sampling.bagging(events(spark, sf), 4, 0.5, 2)


@query("balanced_bagging")
def _balanced_bagging(spark, sf):
    return sampling.balanced_bagging(events(spark, sf), 4, 0.8, 0.2, 1)


@query("bagging_by_query")
def _bagging_by_query(spark, sf):
    return sampling.bagging_by_query(events(spark, sf), 4, 0.5, 2)


@query("goss")
def _goss(spark, sf):
    rows = graded(spark, sf).withColumn("row_id", F.xxhash64(*_ROW, "l_extendedprice"))
    return sampling.goss(rows, 3).select(*_ROW, "g", "h", "goss_weight")


# --- training ---

_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def train_rows(spark, sf):
    return lines(spark, sf).select(
        F.xxhash64(*_ROW, "l_extendedprice").alias("row_id"), *_FEATURES, "l_linenumber", F.col("y_bin").alias("label"),
        "y_class", "y_reg", "y_count", (F.col("l_suppkey") % 25).cast("double").alias("supplier"),
    )


def _nodes_of(spark, result):
    nodes = model.to_tables(spark, result.model)[0]
    return nodes.select("tree_id", "iteration", "class_id", "node_id", "feature", "threshold", "left", "right", "gain", "value", "count")


def _params(**over):
    """Five rounds of 15 leaves unless told otherwise; bins from all rows."""
    tree = trees.TreeParams(num_leaves=over.pop("num_leaves", 15), **over.pop("tree", {}))
    return training.TrainParams(**{"objective": "binary", "num_iterations": 5, "bin_construct_sample_cnt": None, "tree": tree, **over})


_STUMP_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS f, {c} + 0e0 AS v, sum(l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 3" for i, c in enumerate(_FEATURES)
)


@query(
    "grow_tree",
    f"""WITH m AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS p, count(*) AS tn FROM lineitem),
            v AS ({_STUMP_VALUES}),
            u AS (SELECT feature, f, v, lead(v) OVER w AS nv, sum(n) OVER w AS ln, p * sum(n) OVER w - sum(r) OVER w AS lg, p * (1 - p) AS h, tn
                  FROM v, m WINDOW w AS (PARTITION BY f ORDER BY v)),
            g AS (SELECT *, lg * lg / (h * ln) + lg * lg / (h * (tn - ln)) AS gain FROM u WHERE ln >= 20 AND tn - ln >= 20),
            b AS (SELECT * FROM g ORDER BY gain DESC, f, v LIMIT 1)
        SELECT feature, CASE WHEN v = 0 THEN 1e-35 ELSE nextafter((v + nv) / 2, 'Infinity'::DOUBLE) END AS threshold, {sql6('gain')} AS gain, tn AS count FROM b""",
)
def _grow_tree(spark, sf):
    """The first tree with two leaves: its split is the best cut of all values."""
    got = training.train(train_rows(spark, sf), _FEATURES, _params(num_iterations=1, num_leaves=2))
    return _nodes_of(spark, got).select("feature", "threshold", to_places(F.col("gain")).alias("gain"), "count")


def _trainer(name, label="label", features=_FEATURES, categorical=(), **over):
    @query(name)
    def run(spark, sf):
        df = train_rows(spark, sf).withColumn("label", F.col(label))
        return _nodes_of(spark, training.train(df, list(features), _params(**dict(over)), categorical))

    return run


_LEAF_SUMS = "t int, leaf int, n long, g double, h double, before double, after double, start double"


def _leaf_sums(values, forest):
    """Arrow batches of (label, start, at, inside) to sums by tree and leaf: rows, gradients and hessians at the
    scores before the round, and the loss before and after it.

    A forest's trees are averaged and all start anew; else the first tree carries the start. Rows without a label
    count, but add to no sum that reads it.
    """

    def run(batches):
        held = [{} for _ in values]
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            label, start = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "start"))
            at = batch.column("at").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            bagged = batch.column("inside").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if "inside" in batch.schema.names else None
            total = np.zeros(rows)
            for t, of_leaf in enumerate(values):
                leaf = at[:, t]
                before, total = total, total + np.array(of_leaf)[leaf]
                s, e = (start, start + (total - before - start)) if forest else (start if t == 0 else before, total)
                mine = slice(None) if bagged is None else np.flatnonzero(bagged[:, t].astype(bool))
                leaf, s, e, y = leaf[mine], s[mine], e[mine], label[mine]
                p = 1 / (1 + np.exp(-s))
                cells = (p - y, p / (1 + np.exp(s)), np.log(1 + np.exp(s)) - y * s, np.log(1 + np.exp(e)) - y * e)
                found = [np.bincount(leaf, minlength=len(of_leaf))]
                for x in cells:  # null adds nothing, and a sum of nulls alone is null
                    known = ~np.isnan(x)
                    found.append(np.bincount(leaf[known], weights=x[known], minlength=len(of_leaf)))
                    found.append(np.bincount(leaf[known], minlength=len(of_leaf)))
                held[t]["start"] = start[0]
                held[t]["sums"] = [a + b for a, b in zip(held[t]["sums"], found)] if "sums" in held[t] else found
        for t, of_tree in enumerate(held):
            if of_tree:
                n, *pairs = of_tree["sums"]
                some = np.flatnonzero(n)
                known = [pa.array(x[some], mask=k[some] == 0) for x, k in zip(pairs[::2], pairs[1::2])]
                first = pa.array(np.full(len(some), of_tree["start"]), from_pandas=True)
                columns = [np.full(len(some), t, np.int32), some.astype(np.int32), n[some].astype(np.int64), *known, first]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "leaf", "n", "g", "h", "before", "after", "start"])

    return run


def audited(df, trained, params, offset=0):
    """(iteration, rows, leaves, wrong_counts, wrong_values, falls): a binary model checked against its rows.

    Every row is walked through the saved trees from its raw features. From the scores before a
    round, the gradients and hessians of a leaf's rows give its value anew; counts, values and the
    loss before and after the round are compared with what the model says.
    """
    forest, rate = params.boosting == "rf", 1.0 if params.boosting == "rf" else params.learning_rate
    got = trained.model
    start = df.agg(F.expr("ln(avg(label) / (1 - avg(label)))").alias("start"))  # one row
    walked = scoring.predict_leaf(df, got, "at").select("row_id", "label", "at").join(F.broadcast(start))
    bags = [sampling.bag_condition(F.col("row_id"), i, params.bagging_fraction, params.bagging_freq, params.bagging_seed) for i in range(len(got.trees))]
    inside = None if all(b is None for b in bags) else F.array(*[F.lit(True) if b is None else b for b in bags])
    parts = walked.select("label", "start", "at", *([] if inside is None else [inside.alias("inside")]))
    sums = parts.mapInArrow(_leaf_sums([[x.value for x in t.leaves] for t in got.trees], forest), _LEAF_SUMS)
    leaves = sums.groupBy("t", "leaf").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h", "before", "after")], F.max("start").alias("start"))
    held = model.to_tables(df.sparkSession, got)[1].select(F.col("tree_id").alias("t"), F.col("leaf_id").alias("leaf"), "value", "count")
    both = held.join(leaves, ["t", "leaf"], "left").where(F.col("t") >= offset)
    shift = "start" if forest else "if(t = 0, start, 0D)"
    return both.groupBy(F.col("t").alias("iteration")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("leaves"), F.count_if(~F.col("n").eqNullSafe(F.col("count"))).alias("wrong_counts"),
        F.expr(f"count_if(n IS NULL OR abs(value - ({shift} - {rate!r}D * g / h)) > 1e-6)").alias("wrong_values"), F.expr("sum(after) < sum(before)").alias("falls"),
    )


def _audit_sql(rounds, leaves=None, rows="(SELECT count(*) FROM lineitem)", extra="", valued=True):
    return (
        f"SELECT CAST(i AS INTEGER) AS iteration, {rows} AS rows{f', CAST({leaves} AS BIGINT) AS leaves' if leaves else ''}, CAST(0 AS BIGINT) AS wrong_counts, "
        f"{'CAST(0 AS BIGINT) AS wrong_values, ' if valued else ''}true AS falls{extra} FROM range({rounds}) t(i)"
    )


def _audited_trainer(name, shape=None, rounds=5, leaves=None, features=_FEATURES, categorical=(), valued=True, **over):
    """`shape` is SQL for what holds of all nodes of a tree, an aggregate per tree. Leaves under a
    set of categories carry a penalty of their own, so their values are not audited (`valued`)."""

    @query(name, _audit_sql(rounds, leaves, valued=valued, extra=", true AS shaped" if shape is not None else ""))
    def run(spark, sf):
        df, p = train_rows(spark, sf), _params(num_iterations=rounds, **dict(over))
        got = training.train(df, list(features), p, categorical)
        out = audited(df, got, p)
        if shape is not None:
            nodes = model.to_tables(spark, got.model)[0]
            out = out.join(nodes.groupBy("iteration").agg(F.expr(shape).alias("shaped")), "iteration")
        return out.drop(*([] if leaves else ["leaves"]), *([] if valued else ["wrong_values"]))

    return run


_audited_trainer("train_gbdt", rounds=25, leaves=31, num_leaves=31)
_audited_trainer("train_categorical", shape="count_if(kind = 'categorical') > 0", features=[*_FEATURES, "supplier"], categorical=["supplier"], valued=False)
_audited_trainer("feature_sample", shape="count(DISTINCT feature) <= 2", feature_fraction=0.67)
_audited_trainer("extra_trees", tree={"extra_trees": True})
_audited_trainer(
    "interaction_constraints", shape="count_if(feature = 'l_discount') = 0 OR count(DISTINCT feature) = 1", tree={"interaction_constraints": (("l_quantity", "l_tax"), ("l_discount",))}
)
_audited_trainer(
    "forced_splits", shape="max(CASE WHEN node_id = 0 THEN feature = 'l_tax' END)",
    tree={"forced_splits": {"feature": "l_tax", "threshold": 0.04, "left": {"feature": "l_quantity", "threshold": 20.0}}},
)
_audited_trainer("cegb", shape="count_if(feature = 'l_tax') = 0", tree={"cegb_penalty_split": 1e-6, "cegb_penalty_feature_coupled": {"l_tax": 1e9}})


@query("train_rf", _audit_sql(5, rows="CAST(0 AS BIGINT)").replace(", true AS falls", ", true AS falls, true AS near"))
def _train_rf(spark, sf):
    """Trees of a forest against the bags they were grown on; a bag holds about its share."""
    df, p = train_rows(spark, sf), _params(boosting="rf", bagging_freq=1, bagging_fraction=0.6)
    n = df.agg(F.count("*").alias("all_rows"))
    out = audited(df, training.train(df, _FEATURES, p), p).join(F.broadcast(n))  # n is one row
    near = F.abs(F.col("rows") / F.col("all_rows") - 0.6) < 0.05
    return out.select("iteration", F.lit(0).cast("long").alias("rows"), "wrong_counts", "wrong_values", "falls", near.alias("near"))


_trainer("train_dart", boosting="dart", drop_rate=0.9, skip_drop=0.0)
_trainer("train_multiclass", label="y_class", objective="multiclass", objective_params=ObjectiveParams(num_class=5))
_trainer("train_goss", data_sample_strategy="goss", learning_rate=1.0)
_trainer("quantised_gradients", use_quantized_grad=True)
_trainer("monotone", label="y_reg", objective="regression", tree={"monotone_constraints": {"l_quantity": 1}})
_trainer("linear_leaves", label="y_reg", objective="regression", linear_tree=True, linear_lambda=0.1)
_trainer("train_regression_l1", label="y_reg", objective="regression_l1")


_TRIPLE_SQL = "SELECT l_orderkey AS row_id, CAST(l_linenumber - 1 AS INTEGER) AS feature, max(floor(l_quantity / 10)) AS value FROM lineitem GROUP BY 1, 2"


def triples(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), (F.col("l_linenumber") - 1).alias("feature"), F.floor(F.col("l_quantity") / 10).alias("value")
    )


def _sparse_labels(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 3 == 0).cast("double").alias("label"), "o_custkey")


@query(
    "sparse_histogram",
    f"""WITH t AS ({_TRIPLE_SQL}), o AS (SELECT o_orderkey, o_orderkey % 2 AS node, o_custkey AS g FROM orders),
          d AS (SELECT node, f AS feature, CAST(coalesce(value, 0) AS INTEGER) AS bin, g FROM o CROSS JOIN range(0, 7) x(f) LEFT JOIN t ON t.row_id = o_orderkey AND t.feature = f)
        SELECT CAST(node AS BIGINT) AS node, CAST(feature AS INTEGER) AS feature, bin, CAST(sum(g) AS BIGINT) AS g, count(*) AS h, count(*) AS n FROM d GROUP BY ALL""",
)
def _sparse_histogram(spark, sf):
    """Each value has a bin of its own here, so a bin is a value; the zeros are never stored."""
    specs = [B.FeatureBins(f"f{i}", bounds=[0.5, 1.5, 2.5, 3.5, 4.5, float("inf")], sparse=True) for i in range(7)]
    rows = sparse.sparse_rows(_sparse_labels(spark, sf), triples(spark, sf), specs)
    zero = spark.createDataFrame([(i, 0) for i in range(7)], "feature int, zero int")
    keyed = rows.select((F.col("row_id") % 2).alias("node"), F.col("o_custkey").alias("g"), F.lit(1).cast("long").alias("h"), "bins")
    return sparse.sparse_histogram(keyed, ["node"], zero)


_CUT_SUMS = " UNION ALL ".join(f"SELECT {i} AS f, {c} AS v, sum(g) AS g, sum(h) AS h, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY {c}" for i, c in enumerate(_FEATURES))
_CELL_VALUES = ", ".join(f"{c} + 0e0 AS {c}" for c in _FEATURES)
_OF_FEATURE = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_FEATURES))
_FEATURE_NAME = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_FEATURES))


@query(
    "train_stumps",
    f"""WITH RECURSIVE c AS (SELECT {_CELL_VALUES}, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY ALL),
        m AS (SELECT ln(sum(r) / sum(n) / (1 - sum(r) / sum(n))) AS start FROM c),
        run AS (SELECT 0 AS i, c.*, start, start AS s, CAST(NULL AS INTEGER) AS f, 0e0 AS threshold, 0e0 AS gain, 0e0 AS lv, 0e0 AS rv FROM c, m UNION ALL
          (WITH e AS (SELECT *, n / (1 + exp(-s)) - r AS g, n / (1 + exp(-s)) / (1 + exp(s)) AS h FROM run), x AS ({_CUT_SUMS}),
             u AS (SELECT f, v, lead(v) OVER w AS nv, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln,
                     sum(g) OVER (PARTITION BY f) AS tg, sum(h) OVER (PARTITION BY f) AS th, sum(n) OVER (PARTITION BY f) AS tn FROM x WINDOW w AS (PARTITION BY f ORDER BY v)),
             b AS (SELECT *, lg * lg / lh + (tg - lg) * (tg - lg) / (th - lh) - tg * tg / th AS gain FROM u WHERE ln >= 20 AND tn - ln >= 20 ORDER BY gain DESC, f, v LIMIT 1)
           SELECT i + 1, {", ".join(_FEATURES)}, e.n, r, start, s + 1e-1 * CASE WHEN (CASE b.f {_OF_FEATURE} END) <= b.v THEN -lg / lh ELSE -(tg - lg) / (th - lh) END,
             b.f, CASE WHEN v = 0 THEN 1e-35 ELSE nextafter((v + nv) / 2, 'Infinity'::DOUBLE) END, b.gain, -1e-1 * lg / lh, -1e-1 * (tg - lg) / (th - lh) FROM e, b WHERE i < 25))
        SELECT DISTINCT CAST(i - 1 AS INTEGER) AS iteration, CASE f {_FEATURE_NAME} END AS feature, threshold, {sql6("gain")} AS gain,
          {sql6("CASE WHEN i = 1 THEN start ELSE 0 END + lv")} AS left_value, {sql6("CASE WHEN i = 1 THEN start ELSE 0 END + rv")} AS right_value FROM run WHERE i > 0""",
)
def _train_stumps(spark, sf):
    """25 rounds of two leaves: every split and every leaf value, each on the scores of those before."""
    got = training.train(train_rows(spark, sf), _FEATURES, _params(num_iterations=25, num_leaves=2))
    nodes, leaves, _ = model.to_tables(spark, got.model)
    value = lambda leaf: leaves.where(F.col("leaf_id") == leaf).select("iteration", to_places(F.col("value")).alias(("left_value", "right_value")[leaf]))
    return nodes.select("iteration", "feature", "threshold", to_places(F.col("gain")).alias("gain")).join(value(0), "iteration").join(value(1), "iteration")


@query("train_lambdarank")
def _train_lambdarank(spark, sf):
    df = events(spark, sf).drop("weight").withColumn("hour", F.col("row_id") % 24).withColumn("kind", F.col("score"))
    p = _params(objective="lambdarank")
    return _nodes_of(spark, training.train(df.drop("score"), ["hour", "kind"], p))


def _ranked_with_positions(spark, sf, rounds):
    """Events by user at eleven positions, and a ranker trained on them."""
    df = positioned(spark, sf).withColumn("hour", F.col("row_id") % 24).withColumn("kind", F.col("score")).drop("weight", "score")
    p = _params(objective="lambdarank", num_iterations=rounds, objective_params=ObjectiveParams(position_bias_regularization=0.125))
    return df, p, training.train(df, ["hour", "kind"], p)


@query("position_bias_first_round", f"SELECT position, {sql6('factor')} AS factor FROM {position_step_sql('0e0', '0e0', '1e-1', '125e-3')}")
def _position_bias_first_round(spark, sf):
    """What a trained ranker says of its positions after one round, whose scores are all 0."""
    got = _ranked_with_positions(spark, sf, 1)[2]
    return got.position_factors.select("position", to_places(F.col("factor")).alias("factor"))


@query(
    "train_position_bias",
    f"SELECT position, n AS rows, CAST(0 AS BIGINT) AS wrong FROM {position_step_sql('0e0', '0e0', '1e-1', '125e-3')}",
)
def _train_position_bias(spark, sf):
    """Five rounds of 15 leaves; the factors are found again from the saved trees, walked from the raw features."""
    df, p, got = _ranked_with_positions(spark, sf, 5)
    again = PositionFactors.zeros(df)
    for done in range(got.model.iterations):
        before = model.Model([t for t in got.model.trees if t.iteration < done] or [Tree([], [Leaf()], 0, 0)], got.model.features, "lambdarank")
        scored = again.added_to(scoring.predict_raw(df, before, "score"))
        again = again.stepped(lambdarank_gradients(scored, p.objective_params), p.learning_rate, p.objective_params.position_bias_regularization)
    sizes = df.where("position IS NOT NULL").groupBy("position").agg(F.count("*").alias("rows"))
    both = sizes.join(got.position_factors, "position", "left").join(again.table.withColumnRenamed("factor", "again"), "position", "left")
    wrong = (F.coalesce(F.abs(F.col("factor") - F.col("again")), F.lit(1.0)) > 1e-6).cast("bigint")
    return both.select("position", "rows", wrong.alias("wrong"))


@query("early_stopping")
def _early_stopping(spark, sf):
    df = train_rows(spark, sf)
    p = _params(early_stopping_round=2, early_stopping_min_delta=1.0, metric=("binary_logloss",))
    split = F.pmod(F.col("row_id"), F.lit(4))
    got = training.train(df.where(split != 0), _FEATURES, p, valid={"held": df.where(split == 0)})
    rows = [(i, key, value) for i, h in enumerate(got.history) for key, value in h.items()]
    return spark.createDataFrame(rows, "iteration int, metric string, value double").withColumn("best_iteration", F.lit(got.best_iteration))


@query("custom_metric", f"SELECT 'hits' AS metric, {sql6('avg(CASE WHEN (l_quantity > 25) = (l_returnflag = chr(82)) THEN 1e0 ELSE 0e0 END)')} AS value FROM lineitem")
def _custom_metric(spark, sf):
    """A caller's aggregate among named metrics of one evaluation."""
    hits = metrics.CustomMetric("hits", lambda: F.avg(((F.col("prediction") > 0.25) == (F.col("label") > 0)).cast("double")), True)
    df = train_rows(spark, sf).withColumn("prediction", F.col("l_quantity") / 100.0)
    out = metrics.eval_all({"all": df}, ["l2", hits]).where("metric = 'hits'")
    return out.select("metric", to_places(F.col("value")).alias("value"))


@query("early_stopping_custom", "SELECT CAST(i AS INTEGER) AS iteration, 1 AS best_iteration, 'held:rows_behind' AS metric FROM range(3) t(i)")
def _early_stopping_custom(spark, sf):
    """A caller's metric that never improves stops training after its patience."""
    df = train_rows(spark, sf)
    behind = metrics.CustomMetric("rows_behind", lambda: F.count_if(F.col("prediction") > 2.0))  # 0 in every round
    p = _params(num_leaves=2, num_iterations=6, early_stopping_round=2, metric=(behind,))
    got = training.train(df, _FEATURES, p, valid={"held": df.where(F.pmod(F.col("row_id"), F.lit(4)) == 0)})
    rows = [(i, got.best_iteration, key) for i, h in enumerate(got.history) for key in h]
    return spark.createDataFrame(rows, "iteration int, best_iteration int, metric string")


@query("continue_training", _audit_sql(5))
def _continue_training(spark, sf):
    """Three rounds, saved and loaded, and two more: all five as if they had been one run."""
    df = train_rows(spark, sf)
    first = training.train(df, _FEATURES, _params(num_iterations=3))
    path = _scratch(spark)
    model.save_model(spark, first.model, path)
    p = _params(num_iterations=2)
    return audited(df, training.train(df, _FEATURES, p, init_model=model.load_model(spark, path)), p).drop("leaves")


@query("rollback_one", f"SELECT {_PLAIN}, {_V0} + {_V1} AS raw FROM {_HOLE_SQL}")
def _rollback_one(spark, sf):
    return _plain(scoring.predict_raw(holed(spark, sf), model.rollback_one(FIXED_MODEL)))


@query("save_model", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _save_model(spark, sf):
    path = _scratch(spark)
    model.save_model(spark, FIXED_MODEL, path)
    return _plain(scoring.predict_raw(holed(spark, sf), model.load_model(spark, path)))


_REFIT_Y = "CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END"


@query(
    "refit",
    f"""WITH r AS (SELECT CAST({_LEAF0} AS INTEGER) AS leaf, {_V0} AS v, h.y FROM (SELECT x.*, y FROM
            (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_REFIT_Y} AS y, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q,
              CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount + 0e0 END AS d, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_tax + 0e0 END AS t FROM lineitem) x) h)
        SELECT leaf, {sql6("9e-1 * any_value(v) + 1e-1 * 1e-1 * -sum(5e-1 - y) / sum(25e-2)")} AS value FROM r GROUP BY leaf""",
)
def _refit(spark, sf):
    first = model.sliced(FIXED_MODEL, 0, 1)
    got = training.refit(holed(spark, sf), first, training.TrainParams(objective="binary"), 0.9)
    rows = model.to_tables(spark, got)[1]
    return rows.select(F.col("leaf_id").alias("leaf"), to_places(F.col("value")).alias("value"))


@query("train_or_load")
def _train_or_load(spark, sf):
    from paddock.plans.train_or_load import train_or_load

    df, path = train_rows(spark, sf), _scratch(spark)
    low_high = df.agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b")).first()
    ends = df.select(*_FEATURES).where(F.col("l_quantity").isin(low_high["a"], low_high["b"]))
    p = _params()
    first = train_or_load(df, _FEATURES, p, path, ends)
    second = train_or_load(df, _FEATURES, p, path, ends)
    return first.unionByName(second)


# --- streams over the table files ---


def _stream(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)


def _hole_stream(spark, sf):
    hole = lambda c, m: F.when(F.col("l_partkey") % m != 0, F.col(c)).alias(c)
    return _stream(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", hole("l_quantity", 7), hole("l_discount", 11),
        hole("l_tax", 13), (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_partkey").alias("row_id"),
    )


@query("stream_bin_append", f"SELECT l_partkey AS row_id, {_REFIT_Y.replace('l_returnflag', 'flag')} AS label, {_PACKED_SQL} AS bins FROM (SELECT h.*, l_returnflag AS flag FROM (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount END AS d, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_tax END AS t FROM lineitem) h)")
def _stream_bin_append(spark, sf):
    path = _scratch(spark)
    streams.stream_bin_append(_hole_stream(spark, sf), _SPECS, path, f"{path}/progress").awaitTermination()
    return _as_text(spark.read.parquet(f"{path}/binned"))


@query("stream_score", f"SELECT {_PLAIN}, {_RAW_SQL} AS raw FROM {_HOLE_SQL}")
def _stream_score(spark, sf):
    path = _scratch(spark)
    scored = _plain(streams.stream_score(_hole_stream(spark, sf), FIXED_MODEL, raw=True))
    q = scored.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("online_refit")
def _online_refit(spark, sf):
    online = streams.OnlineRefit(FIXED_MODEL, training.TrainParams(objective="binary"), 0.9)
    online.start(_hole_stream(spark, sf), f"{_scratch(spark)}/progress").awaitTermination()
    return model.to_tables(spark, online.model)[1].select("tree_id", "leaf_id", to_places(F.col("value")).alias("value"))
