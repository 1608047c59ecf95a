"""Wide payback rows to one row per bet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.text import digits_int
from paddock.operators.race import KEY, race_key, raw_fields

# Bet type, amount column, number columns; rows come out in this order.
BETS = (
    ("WIN", "単勝払戻金（円）", ("単勝組番",)),
    ("PLACE", "複勝払戻金1（円）", ("複勝組番1",)),
    ("PLACE", "複勝払戻金2（円）", ("複勝組番2",)),
    ("PLACE", "複勝払戻金3（円）", ("複勝組番3",)),
    ("BRACKET_QUINELLA", "枠複払戻金（円）", ("枠複組番1", "枠複組番2")),
    ("BRACKET_EXACTA", "枠単払戻金（円）", ("枠単組番1", "枠単組番2")),
    ("QUINELLA", "馬複払戻金（円）", ("馬複組番1", "馬複組番2")),
    ("EXACTA", "馬単払戻金（円）", ("馬単組番1", "馬単組番2")),
    ("WIDE", "ワイド払戻金1（円）", ("ワイド組番1馬番1", "ワイド組番1馬番2")),
    ("WIDE", "ワイド払戻金2（円）", ("ワイド組番2馬番1", "ワイド組番2馬番2")),
    ("WIDE", "ワイド払戻金3（円）", ("ワイド組番3馬番1", "ワイド組番3馬番2")),
    ("TRIO", "３連複払戻金（円）", ("３連複組番馬番1", "３連複組番馬番2", "３連複組番馬番3")),
    ("TRIFECTA", "３連単払戻金（円）", ("３連単組番馬番1", "３連単組番馬番2", "３連単組番馬番3")),
)


def bet_slots(value) -> Column:
    """Array of 13 (bet_type, combination, amount_yen) structs; `value(name)` gives an int column."""
    return F.array(
        *[
            F.struct(
                F.lit(bet).alias("bet_type"),
                F.array(*[value(n) for n in numbers]).alias("combination"),
                value(amount).alias("amount_yen"),
            )
            for bet, amount, numbers in BETS
        ]
    )


def paid_bets(slots: Column) -> Column:
    """Slots with a positive amount and no missing number. Numbers keep their order."""
    return F.filter(
        slots,
        lambda s: F.coalesce(s["amount_yen"] > 0, F.lit(False)) & ~F.exists(s["combination"], lambda n: n.isNull()),
    )


# The fields of `payback_numbers`, in order.
NUMBERS = [n for _, amount, numbers in BETS for n in (amount, *numbers)]


def payback_numbers(table: DataFrame) -> DataFrame:
    """Parsed payback rows to (key, numbers, archive, line_no): all amounts and bet numbers as one array of ints."""
    raw = raw_fields(table, {n: n for n in NUMBERS})
    # One expression over all fields, read once; one of each would be some hundred kilobytes of code.
    numbers = F.transform(F.array(*[F.col(f"`{n}`") for n in NUMBERS]), digits_int)
    return raw.select(*race_key(), F.explode(F.array(numbers)).alias("numbers"), "archive", "line_no")


def with_slots(read: DataFrame) -> DataFrame:
    """`payback_numbers` rows to (key, slots, archive, line_no). Slots are many times as wide as numbers, so rows are best dealt before."""
    value = lambda name: F.col("numbers")[NUMBERS.index(name)]
    return read.select(*KEY, bet_slots(value).alias("slots"), "archive", "line_no")


def map_paybacks(table: DataFrame) -> DataFrame:
    """Parsed payback rows to (key, slots, archive, line_no)."""
    return with_slots(payback_numbers(table))


def unpivot_payouts(paybacks: DataFrame, keep: list[str] = KEY) -> DataFrame:
    """One row per paid bet: (keep, pos, bet_type, combination, amount_yen); narrow, no shuffle."""
    return paybacks.select(*keep, F.posexplode(paid_bets(F.col("slots"))).alias("pos", "bet")).select(
        *keep, "pos", "bet.bet_type", "bet.combination", "bet.amount_yen"
    )


def check_expected_payouts(expected: DataFrame, payouts: DataFrame) -> DataFrame:
    """Expected (key, bet_type, combination, amount_yen) rows that no payout matches.

    Payouts are exploded from races, which Spark's size estimate does not see: left to itself it
    sends all of them through the driver as a broadcast.
    """
    on = [*KEY, "bet_type", "combination", "amount_yen"]
    return expected.join(payouts.select(*on).hint("merge"), on, "left_anti")
