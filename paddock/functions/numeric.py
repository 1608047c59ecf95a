"""Numeric helpers shared by objectives, metrics and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: magnitudes up to this count as zero.
ZERO_LIMIT = 1e-35


def sigmoid(x: Column, slope: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def is_zero(x: Column) -> Column:
    return (x >= -ZERO_LIMIT) & (x <= ZERO_LIMIT)


def snap_zero(x: Column) -> Column:
    return F.when(is_zero(x), F.lit(0.0)).otherwise(x)


def bounded(x: Column) -> Column:
    """NaN becomes 0 and magnitudes stop at 1e300."""
    return (
        F.when(F.isnan(x), F.lit(0.0))
        .when(x >= 1e300, F.lit(1e300))
        .when(x <= -1e300, F.lit(-1e300))
        .otherwise(x)
    )


def round_half_up_int(x: Column) -> Column:
    """Add one half and cut the fraction, so negatives round toward zero."""
    return (x + 0.5).cast("int")


def softmax(scores: Column) -> Column:
    """Softmax of an array<double> column, shifted by its maximum."""
    top = F.array_max(scores)
    grown = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
    return F.transform(grown, lambda e: e / total)


def fixed_point(x: Column, scale: float) -> Column:
    """`round(x * scale)` as a bigint: sums of it are exact in any order."""
    return F.floor(x * scale + 0.5).cast("bigint")


def to_places(x: Column, places: int = 6) -> Column:
    """Round to decimal places by floor(x * 10^p + 1/2) / 10^p, one rule for all engines."""
    factor = float(10**places)
    return F.floor(x * factor + 0.5).cast("double") / F.lit(factor)
