"""Text cleaning and lenient number parsing, as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a field is trimmed.
SPACE_CLASS = r"[\t-\r\x1c-\x1f\p{Z}]"

_EDGE_SPACE = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"

# Decimal digits of the scripts in the basic plane, derived from the Unicode tables.
_WIDE_DIGITS = "".join(
    chr(c) for c in range(128, 0x10000) if unicodedata.decimal(chr(c), None) is not None
)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _WIDE_DIGITS)

# A short number before characters that are digits of no script.
_NUMBER_AND_UNIT = r"^[0-9]{1,9}[\x00-/:-\x7f\u3000-\u9fff]*\z"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, _EDGE_SPACE, "")


def is_blank(x: Column) -> Column:
    return x.rlike(f"^{SPACE_CLASS}*$")


def text_or_null(x: Column) -> Column:
    """Trim Unicode white space; an empty result becomes null."""
    return F.nullif(trimmed(x), F.lit(""))


def digits_int(x: Column) -> Column:
    """Every decimal digit of the text, in order, as one int; null when none or too large.

    Signs, points and brackets are dropped: `-5` is 5 and `470(+2)` is 4702.
    """
    plain = F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(
        F.translate(x, _WIDE_DIGITS, _ASCII_DIGITS)
    )
    # Most fields are nothing but a short number, or one before its unit; they skip the rewriting.
    return (
        F.when(x == "", F.lit(None).cast("int"))
        .when(x.rlike("^[0-9]{1,9}$"), x.cast("int"))
        .when(x.rlike(_NUMBER_AND_UNIT), F.regexp_extract(x, "^[0-9]+", 0).cast("int"))
        .otherwise(F.regexp_replace(plain, "[^0-9]", "").try_cast("int"))
    )


def loose_double(x: Column) -> Column:
    """Digits, points and minus signs of the text parsed as a double, else null.

    Non-ASCII digits survive the filter but do not parse.
    """
    kept = F.regexp_replace(x, r"[^.\-\p{Nd}]|[^\x{0000}-\x{FFFF}]", "")
    return F.when(kept.rlike(r"^\p{ASCII}*$"), kept.try_cast("double"))


def digits_int_strict(x: Column) -> Column:
    """Our addition: only a leading signed integer, so `470(+2)` is 470."""
    lead = F.regexp_extract(trimmed(x), r"^([+-]?[0-9]+)", 1)
    return lead.try_cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_bom(x: Column) -> Column:
    return F.regexp_replace(x, "^﻿", "")


def numeric_token(x: Column) -> Column:
    """A numeric training token as a double.

    Missing words give NaN, infinity words give a signed 1e308, exponents are capped
    at 308; a token that is none of these gives null and belongs in the rejects.
    """
    token = F.regexp_replace(x, "^ +| +$", "")
    word = F.lower(F.regexp_replace(token, r"^[+-]", ""))
    sign = F.when(token.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    mantissa = F.regexp_extract(token, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]*))(?:[eE][+-]?[0-9]*)?$", 1)
    # A bare point or exponent mark counts as zero before the scale is applied.
    mantissa_value = F.coalesce(mantissa.try_cast("double"), F.lit(0.0) * sign)
    exponent_sign = F.regexp_extract(token, r"[eE]([+-]?)[0-9]*$", 1)
    exponent_digits = F.regexp_extract(token, r"[eE][+-]?0*([0-9]*)$", 1)
    exponent = F.when(exponent_digits == "", F.lit(0)).otherwise(
        F.least(F.coalesce(exponent_digits.try_cast("int"), F.lit(308)), F.lit(308))
    )
    is_number = token.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]*|(?=[eE]))(?:[eE][+-]?[0-9]*)?$")
    plain = F.coalesce(token.try_cast("double"), mantissa_value)
    clipped = F.concat(
        F.when(mantissa.rlike("[0-9]"), mantissa).otherwise(F.lit("0")),
        F.lit("e"),
        exponent_sign,
        exponent.cast("string"),
    ).try_cast("double")
    # Most tokens are nothing but a plain number; they skip the rewriting.
    return (
        F.when(x.rlike(r"^[+-]?[0-9]+(?:\.[0-9]*)?\z"), x.try_cast("double"))
        .when(x.isNull() | (token == "") | word.isin("na", "nan", "null"), F.lit(float("nan")))
        .when(word.isin("inf", "infinity"), sign * F.lit(1e308))
        .when(is_number & ~token.rlike("[eE]"), plain)
        .when(is_number, clipped)
    )
