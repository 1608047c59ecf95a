"""Nested race bundles and readable race cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.payouts import paid_bets
from paddock.operators.prefix import positions
from paddock.operators.race import KEY, first_per_key
from paddock.session import written

# Horses per nested row. Real races have far fewer, so they are one row with part 0; a key
# with more rows continues in further parts and no row grows without bound. Only part 0 holds
# the race and its payouts, so sums over bundles count them once.
PART_ROWS = 4096


def race_bundle(
    races: DataFrame, horses: DataFrame, paybacks: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """(key, part, race, entries, outcomes, payouts, rejected), horses in number order.

    `rejected` counts the race's horses without a number or name, which are in no list.

    Horse positions come from a range-partitioned running count, so a hot key is numbered
    by many tasks and collected `part_rows` at a time. Horses are read three times (rejects, bounds of
    the ranges, ranges), so they are written first.
    """
    horses = written(horses)
    named = F.col("horse_no").isNotNull() & F.col("horse_name").isNotNull()
    rejected = horses.where(~named).groupBy(*KEY).agg(F.count("*").alias("rejected"))
    numbered = positions(
        horses.where(named),
        KEY,
        [F.col("horse_no"), F.col("archive"), F.col("line_no")],
    ).withColumn("part", F.floor((F.col("position") - 1) / part_rows).cast("long"))
    entry = F.struct("position", "horse_no", "horse_name", "jockey", "assigned_weight_kg", "body_weight_kg")
    outcome = F.struct("position", "horse_no", "finish_position")
    nested = numbered.groupBy(*KEY, "part").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.sort_array(F.collect_list(outcome)).alias("outcomes"),
    )
    race_fields = [c for c in races.columns if c not in ("archive", "line_no", *KEY)]
    race = first_per_key(races).select(*KEY, F.struct(*race_fields).alias("race"))
    paid = first_per_key(paybacks).select(*KEY, paid_bets(F.col("slots")).alias("payouts"))
    return (
        race.join(paid, KEY, "left")
        .withColumn("payouts", F.coalesce("payouts", F.array()))
        .join(rejected, KEY, "left")
        .join(nested, KEY, "inner")
        .select(
            *KEY, "part", F.when(F.col("part") == 0, F.col("race")).alias("race"), "entries", "outcomes",
            F.when(F.col("part") == 0, F.col("payouts")).otherwise(F.array()).alias("payouts"),
            F.when(F.col("part") == 0, F.coalesce("rejected", F.lit(0))).otherwise(F.lit(0)).alias("rejected"),
        )
    )


def _shown(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


# The labels a race card prints.
RACE_LINE = (
    ("発走=", "post_time"),
    ("距離=", "distance_m"),
    ("天候=", "weather"),
    ("馬場=", "track_condition"),
    ("頭数=", "declared_count"),
    ("レース名=", "race_name"),
)
HORSE_LINE = (
    (" / 騎手=", "jockey"),
    (" / 斤量=", "assigned_weight_kg"),
    (" / 馬体重=", "body_weight_kg"),
    (" / 着順=", "finish_position"),
)
BET_LABELS = {
    "WIN": "単勝",
    "PLACE": "複勝",
    "BRACKET_QUINELLA": "枠複",
    "BRACKET_EXACTA": "枠単",
    "QUINELLA": "馬複",
    "EXACTA": "馬単",
    "WIDE": "ワイド",
    "TRIO": "３連複",
    "TRIFECTA": "３連単",
}


def race_lines(races: DataFrame) -> DataFrame:
    """One line per race field: (key, section, pos, line)."""
    title = F.concat(
        F.lit("競馬場="), _shown(F.col("track")), F.lit(" 日付="), _shown(F.col("race_date")),
        F.lit(" レース="), _shown(F.col("race_no")), F.lit("R"),
    )
    lines = [title, *[F.concat(F.lit(label), _shown(F.col(c))) for label, c in RACE_LINE]]
    return races.select(*KEY, F.lit(1).alias("section"), F.posexplode(F.array(*lines)).alias("pos", "line"))


def horse_lines(horses: DataFrame) -> DataFrame:
    """One line per horse; `pos` is its horse number."""
    line = F.concat(
        _shown(F.col("horse_no")), F.lit(" "), _shown(F.col("horse_name")),
        *[F.concat(F.lit(label), _shown(F.col(c))) for label, c in HORSE_LINE],
    )
    return horses.select(*KEY, F.lit(2).alias("section"), F.col("horse_no").alias("pos"), line.alias("line"))


def payout_lines(payouts: DataFrame) -> DataFrame:
    """One line per paid bet: label, numbers joined by `-`, amount."""
    labels = F.create_map(*[F.lit(x) for pair in BET_LABELS.items() for x in pair])
    line = F.concat(
        labels[F.col("bet_type")], F.lit("="),
        F.array_join(F.transform("combination", lambda n: n.cast("string")), "-"),
        F.lit(" "), _shown(F.col("amount_yen")), F.lit("円"),
    )
    return payouts.select(*KEY, F.lit(3).alias("section"), "pos", line.alias("line"))


def race_card(races: DataFrame, horses: DataFrame, payouts: DataFrame) -> DataFrame:
    """Readable report, one row per line with (section, pos); narrow, no shuffle of its own."""
    return race_lines(races).unionByName(horse_lines(horses)).unionByName(payout_lines(payouts))
