"""Value bins: finding them, applying them, and describing them.

A bin table has rows (feature, kind, bin, upper_bound, category, missing_type, rows). The
number of bins per feature is limited by `max_bin`, so everything after the first
aggregate is small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.functions.numeric import ZERO_LIMIT
from paddock.operators.columns import unpivot
from paddock.operators.prefix import running_totals

# Default limits.
MAX_BIN = 255
MIN_DATA_IN_BIN = 3


def missing_types(df: DataFrame, use_missing: bool = True, zero_as_missing: bool = False) -> DataFrame:
    """(feature, missing_type) of a long (feature, value) table: NaN only where NaN occurs."""
    if not use_missing:
        kind = F.lit("none")
    elif zero_as_missing:
        kind = F.lit("zero")
    else:
        kind = F.when(F.count_if(F.isnan("value")) > 0, "nan").otherwise("none")
    return df.groupBy("feature").agg(kind.alias("missing_type"))


def next_up(x: Column) -> Column:
    """The next larger double: one step of the value's own spacing.

    ulp(x) is 2^(exponent - 52), and adding it moves a positive double up by one step and
    a negative one by one, or by half-spacing at powers of two, which rounds up all the same.
    """
    size = F.greatest(F.abs(x), F.lit(2.2250738585072014e-308))
    exponent = F.floor(F.log2(size))
    return x + F.pow(F.lit(2.0), exponent - 52)


def find_numeric_bins(
    values: DataFrame,
    max_bin: int = MAX_BIN,
    min_data_in_bin: int = MIN_DATA_IN_BIN,
    max_bin_by_feature: dict[str, int] | None = None,
    forced: DataFrame | None = None,
    use_missing: bool = True,
    zero_as_missing: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Bins of a long (feature, value) table; NaN marks a missing value. `weight` names a column of row counts.

    Values combine per (feature, value) first. With few distinct values each has a bin;
    otherwise cuts fall at equal shares of the row count, taken from a range-partitioned
    running total, so neither a feature nor a value is ever gathered in one task. Zero
    always has a bin of its own; bins short of `min_data_in_bin` rows join their neighbour;
    a bound is the next double above the midpoint of the values it parts, the last is
    infinite; NaN, where it occurs, gets the last bin. Bounds in `forced`
    (feature, upper_bound) always part bins.
    """
    limit = F.lit(max_bin)
    for name, own in (max_bin_by_feature or {}).items():
        limit = F.when(F.col("feature") == name, F.lit(own)).otherwise(limit)
    given = F.col("value") if use_missing else F.nanvl("value", F.lit(0.0))
    zeroed = F.when(F.abs(given) <= ZERO_LIMIT, F.lit(0.0)).otherwise(given)
    # The one pass over the rows. NaN is one more value here, and sorts last.
    counts = values.groupBy("feature", zeroed.alias("value")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    upto = running_totals(counts, ["feature"], [F.col("value")], {"upto": F.col("n"), "place": F.lit(1).cast("bigint")})
    lost = F.isnan("value")
    sizes = upto.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(~lost, F.col("n"))), F.lit(0)).alias("rows"),
        F.count_if(~lost).alias("distinct"),
        F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("holes"),
    )
    # Two bins are kept back for the cuts around zero, one for missing values.
    budget = F.greatest(F.least(limit - 3, F.floor(F.col("rows") / max(min_data_in_bin, 1))), F.lit(1))
    share = F.floor((F.col("upto") - F.col("n")) * budget / F.col("rows"))
    room = limit - (F.col("holes") > 0).cast("int")
    slot = F.when(F.col("distinct") <= room, F.col("place")).otherwise(share).cast("long")
    staged = upto.join(F.broadcast(sizes), "feature")  # one row per feature column
    if forced is None:
        zone, bounds = F.lit(0), F.array().cast("array<double>")
    else:
        own = forced.groupBy("feature").agg(F.sort_array(F.collect_set("upper_bound")).alias("forced"))
        staged = staged.join(F.broadcast(own), "feature", "left")
        below = F.size(F.filter("forced", lambda b: b < F.col("value")))
        zone, bounds = F.when(F.col("forced").isNull(), 0).otherwise(below), F.col("forced")
    staged = staged.where(~lost | (F.col("distinct") == 0)).select(
        "feature", "value", "n", "holes", slot.alias("slot"), F.signum("value").cast("int").alias("side"),
        zone.alias("zone"), bounds.alias("forced"),
    )
    # From here on there are at most max_bin rows per feature.
    rough = staged.groupBy("feature", "zone", "side", "slot").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n"), F.any_value("forced").alias("forced"),
        F.any_value("holes").alias("holes"),
    )
    merged = rough.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "n", "zone", "side"))).alias("parts"),
        F.any_value("forced").alias("forced"), F.any_value("holes").alias("holes"),
    ).select("feature", "forced", "holes", _merge_small(F.col("parts"), min_data_in_bin).alias("parts"))
    bounded = merged.select("feature", "holes", _with_bounds(F.col("parts"), F.col("forced")).alias("cells"))
    nan_bin = use_missing and not zero_as_missing
    last = F.struct(F.lit(float("nan")).alias("upper_bound"), F.col("holes").alias("rows"))
    cells = F.when((F.col("holes") > 0) & F.lit(nan_bin), F.concat("cells", F.array(last))).otherwise(F.col("cells"))
    if not use_missing:
        kind = F.lit("none")
    elif zero_as_missing:
        kind = F.lit("zero")
    else:
        kind = F.when(F.col("holes") > 0, "nan").otherwise("none")
    return bounded.select("feature", kind.alias("missing_type"), F.posexplode(cells).alias("bin", "c")).select(
        "feature", F.lit("numeric").alias("kind"), "bin", "c.upper_bound", F.lit(None).cast("int").alias("category"),
        "missing_type", "c.rows",
    )


def _with_bounds(parts: Column, forced: Column) -> Column:
    """Ordered parts to (upper_bound, rows); the bound lies between a part and the next one."""

    def bound(p: Column, i: Column) -> Column:
        n = F.get(parts, i + 1)
        upper = (
            F.when(i == F.size(parts) - 1, F.lit(float("inf")))
            .when(n["zone"] > p["zone"], F.get(forced, n["zone"] - 1))
            .when((p["hi"] < 0) & (n["lo"] >= 0), F.lit(-ZERO_LIMIT))
            .when((p["hi"] == 0) & (n["lo"] > 0), F.lit(ZERO_LIMIT))
            .otherwise(next_up((p["hi"] + n["lo"]) / 2.0))
        )
        return F.struct(upper.alias("upper_bound"), p["n"].alias("rows"))

    return F.transform(parts, bound)


def _merge_small(parts: Column, least: int) -> Column:
    """Fold ordered parts: a part joins the one before it while that one is too small.

    Parts on different sides of zero or of a forced bound never join.
    """
    empty = F.filter(parts, lambda p: F.lit(False))

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        join = (F.size(done) > 0) & (last["n"] < least) & (last["side"] == p["side"]) & (last["zone"] == p["zone"])
        grown = F.struct(
            last["lo"].alias("lo"), p["hi"].alias("hi"), (last["n"] + p["n"]).alias("n"), p["zone"].alias("zone"), p["side"].alias("side")
        )
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(join, F.concat(kept, F.array(grown))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, empty, step)


def find_category_bins(values: DataFrame, max_bin: int = MAX_BIN) -> DataFrame:
    """(feature, bin, category, rows): categories in descending count, ties by value.

    Bin 0 is kept for negative, missing and unseen values; fractions are cut toward zero.
    Only the `max_bin` - 1 most frequent categories get bins, cut before the shuffle.
    """
    category = F.when(~F.isnan("value"), F.col("value")).try_cast("int")  # too large to be one: dropped
    counts = (
        values.withColumn("category", category)
        .where("category >= 0")
        .groupBy("feature", "category")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    rank = F.row_number().over(W.partitionBy("feature").orderBy(F.col("rows").desc(), "category"))
    return counts.withColumn("bin", rank).where(F.col("bin") < max_bin).select("feature", "bin", "category", "rows")


@dataclass
class FeatureBins:
    """Bins of one feature on the driver: never more than the bin limit."""

    name: str
    kind: str = "numeric"
    bounds: list[float] = field(default_factory=list)
    categories: list[int] = field(default_factory=list)
    missing_type: str = "none"
    sparse: bool = False  # rows keep a map of bins, without the zero bin

    @property
    def num_bins(self) -> int:
        if self.kind == "categorical":
            return len(self.categories) + 1
        return len(self.bounds) + (self.missing_type == "nan")

    @property
    def default_bin(self) -> int:
        """Bin of the value zero."""
        if self.kind == "categorical":
            return self.categories.index(0) + 1 if 0 in self.categories else 0
        return sum(1 for b in self.bounds if b < 0.0)

    @property
    def nan_bin(self) -> int | None:
        return len(self.bounds) if self.missing_type == "nan" and self.kind == "numeric" else None

    @property
    def missing_bin(self) -> int:
        """Bin whose rows take the default direction; -1 when there is none."""
        if self.kind == "categorical" or self.missing_type == "none":
            return -1
        return self.nan_bin if self.missing_type == "nan" else self.default_bin


def value_to_bin(x: Column, spec: FeatureBins) -> Column:
    """First bin whose bound is not below the value, as a native expression.

    The bounds become a balanced chain of comparisons: about log2(bins) of them per row.
    """
    if spec.kind == "categorical":
        whole = F.when(F.isnan(x) | x.isNull(), F.lit(-1)).otherwise(x.try_cast("int"))
        if not spec.categories:
            return F.lit(0)
        table = F.create_map(*[F.lit(v) for i, c in enumerate(spec.categories, 1) for v in (c, i)])
        return F.coalesce(F.try_element_at(table, whole), F.lit(0))
    filled = F.coalesce(x.cast("double"), F.lit(float("nan")))
    if spec.missing_type != "nan":
        filled = F.nanvl(filled, F.lit(0.0))
    # A one-element transform binds the value once for the whole chain of comparisons.
    found = F.transform(F.array(filled), lambda v: _search(spec.bounds[:-1], 0, v))[0]
    return F.when(F.isnan(filled), F.lit(spec.nan_bin)).otherwise(found) if spec.missing_type == "nan" else found


def _search(bounds: list[float], offset: int, x: Column) -> Column:
    if not bounds:
        return F.lit(offset)
    mid = (len(bounds) - 1) // 2
    below, above = _search(bounds[:mid], offset, x), _search(bounds[mid + 1 :], offset + mid + 1, x)
    return F.when(x <= F.lit(bounds[mid]), below).otherwise(above)


def bin_to_value(bins: DataFrame, spec: DataFrame) -> DataFrame:
    """(feature, bin) rows with their upper bound or category; at most the bin limit per feature."""
    lookup = spec.select(
        "feature", "bin", F.when(F.col("kind") == "categorical", F.col("category").cast("double")).otherwise(F.col("upper_bound")).alias("value")
    )
    return bins.join(lookup, ["feature", "bin"])


def bin_stats(binned: DataFrame, features: list[str], default_bins: dict[str, int] | None = None) -> DataFrame:
    """(feature, num_bins, most_freq_bin, sparse_rate) of binned columns: counts per bin
    combine before the shuffle."""
    long = binned.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in features])))
    counts = long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    for name, b in (default_bins or {}).items():
        zero = F.when(F.col("feature") == name, F.lit(b)).otherwise(zero)
    return counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("num_bins"),
        F.max_by("bin", F.struct("n", -F.col("bin"))).alias("most_freq_bin"),
        (F.sum(F.when(F.col("bin") == zero, F.col("n")).otherwise(0)) / F.sum("n")).alias("sparse_rate"),
    )


def category_bitset(x: Column, categories: list[int]) -> Column:
    """Whether a value, cut toward zero, is in a category set; negative and missing are not."""
    whole = F.when(F.isnan(x), F.lit(None)).otherwise(x).try_cast("int")
    return F.coalesce(whole.isin(*categories) & (whole >= 0), F.lit(False))


def collect_spec(spec: DataFrame) -> list[FeatureBins]:
    """Bin table to driver-side bins: features x bin limit rows at most."""
    out: dict[str, FeatureBins] = {}
    for r in spec.orderBy("feature", "bin").collect():
        b = out.setdefault(r["feature"], FeatureBins(r["feature"], r["kind"], missing_type=r["missing_type"] or "none"))
        if r["kind"] == "categorical":
            b.categories.append(r["category"])
        elif r["upper_bound"] == r["upper_bound"]:
            b.bounds.append(r["upper_bound"])
    return list(out.values())


SPEC_SCHEMA = "feature string, kind string, bin int, upper_bound double, category int, missing_type string, rows long"


def make_bins(
    df: DataFrame, numeric: list[str], categorical: list[str] = (), sample: DataFrame | None = None, max_cat_bin: int = MAX_BIN, **limits
) -> DataFrame:
    """Bin table of feature columns, from `sample` when given, else from every row."""
    source = df if sample is None else sample
    parts = []
    if numeric:
        parts.append(find_numeric_bins(unpivot(source, list(numeric)), **limits))
    if categorical:
        found = find_category_bins(unpivot(source, list(categorical)), max_cat_bin)
        parts.append(
            found.select(
                "feature", F.lit("categorical").alias("kind"), "bin", F.lit(None).cast("double").alias("upper_bound"),
                "category", F.lit("none").alias("missing_type"), "rows",
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def bin_table(df: DataFrame, specs: list[FeatureBins], keep: list[str] = (), packed: bool = False) -> DataFrame:
    """Every feature column to its bin in one narrow projection.

    `packed` gives one array<int> column `bins` in the order of `specs`.
    """
    cells = [value_to_bin(F.col(s.name), s) for s in specs]
    if packed:
        return df.select(*keep, F.array(*[c.cast("int") for c in cells]).alias("bins"))
    return df.select(*keep, *[c.cast("int").alias(s.name) for c, s in zip(cells, specs)])


def check_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in which two bin tables differ; none means they are aligned."""
    same = ["feature", "kind", "bin", "upper_bound", "category", "missing_type"]
    a, b = left.select(*same), right.select(*same)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
