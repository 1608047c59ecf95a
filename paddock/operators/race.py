"""Typed race tables, their key joins and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.csv import csv_values
from paddock.functions.text import digits_int, loose_double, text_or_null
from paddock.operators.joins import HOT_ROWS, skewed_join
from paddock.operators.prefix import first_rows

KEY = ["track", "race_date", "race_no"]

# CSV column names of the three tables.
KEY_COLUMNS = ("競馬場", "競走年月日", "レース番号")
RACE_COLUMNS = {
    "post_time": "発走時刻",
    "distance_m": "距離",
    "weather": "天候",
    "track_condition": "馬場",
    "declared_count": "頭数",
    "race_name": "レース名",
}
HORSE_COLUMNS = {
    "horse_no": "馬番",
    "horse_name": "馬名",
    "jockey": "騎手名",
    "assigned_weight_kg": "負担重量",
    "body_weight_kg": "馬体重",
    "finish_position": "着順",
}


def raw_fields(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """Key and named fields of a `csv_table` as strings, each looked up once.

    Rows leave through a generator of one row, below which Spark pushes no condition: a condition on
    typed columns, as a join makes one for each key, would else split the line again for itself. The
    fields leave as one array: a lookup for each in one piece of generated code is more than the JVM compiles.
    """
    wanted = {**dict(zip(KEY, KEY_COLUMNS)), **names}
    found = table.select("archive", "line_no", F.explode(F.array(csv_values(F.col("fields"), F.col("header"), list(wanted.values())))).alias("found"))
    return found.select("archive", "line_no", *[F.get("found", F.lit(i)).alias(out) for i, out in enumerate(wanted)])


def race_key() -> list[Column]:
    """Key of a raw row: the track untrimmed, date and number through `digits_int`."""
    return [
        F.col("track"),
        digits_int(F.col("race_date")).alias("race_date"),
        digits_int(F.col("race_no")).alias("race_no"),
    ]


def filter_race(rows: DataFrame, track: str, race_date: int, race_no: int) -> DataFrame:
    return rows.where((F.col("track") == track) & (F.col("race_date") == race_date) & (F.col("race_no") == race_no))


def filter_races(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in `keys`; a key with very many rows is spread over tasks."""
    return skewed_join(rows, keys.select(*KEY).distinct(), KEY, "left_semi")


def map_race(table: DataFrame) -> DataFrame:
    """Race columns of a parsed race list, with the line order kept for `first_per_key`."""
    text = {"weather", "track_condition", "race_name"}
    columns = [
        (text_or_null(F.col(c)) if c in text else digits_int(F.col(c))).alias(c) for c in RACE_COLUMNS
    ]
    return raw_fields(table, RACE_COLUMNS).select(*race_key(), *columns, "archive", "line_no")


def map_horses(table: DataFrame) -> DataFrame:
    """All horse columns typed; `map_entries` and `map_outcomes` split it at the start of the race."""
    parse = {
        "horse_name": text_or_null,
        "jockey": text_or_null,
        "assigned_weight_kg": loose_double,
    }
    columns = [parse.get(c, digits_int)(F.col(c)).alias(c) for c in HORSE_COLUMNS]
    return raw_fields(table, HORSE_COLUMNS).select(*race_key(), *columns, "archive", "line_no")


def map_entries(horses: DataFrame) -> DataFrame:
    """What is known before the start; rows lacking number or name are in `entry_rejects`."""
    known = horses.where(F.col("horse_no").isNotNull() & F.col("horse_name").isNotNull())
    return known.select(
        *KEY, "horse_no", "horse_name", "jockey", "assigned_weight_kg", "body_weight_kg", "archive", "line_no"
    )


def entry_rejects(horses: DataFrame) -> DataFrame:
    reason = F.when(F.col("horse_no").isNull(), "Horse number missing").when(
        F.col("horse_name").isNull(), "Horse name missing"
    )
    return horses.withColumn("reason", reason).where(F.col("reason").isNotNull())


def map_outcomes(horses: DataFrame) -> DataFrame:
    """What is fixed after the race; the finish is null for scratched horses."""
    return horses.where(F.col("horse_no").isNotNull()).select(
        *KEY, "horse_no", "finish_position", "archive", "line_no"
    )


def first_per_key(rows: DataFrame, key: list[str] = KEY, order: list[str] = ("archive", "line_no")) -> DataFrame:
    """The first row of each key in file order."""
    return first_rows(rows, list(key), [F.col(c) for c in order])


def join_race_horses(races: DataFrame, horses: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """First race row of each key with all its horses.

    File columns stay those of the horse row.
    """
    race = first_per_key(races).drop("archive", "line_no")
    return skewed_join(horses, race, KEY, "inner", hot_rows)


def join_payback(races: DataFrame, payouts: DataFrame, payload: str = "payouts") -> DataFrame:
    """Races with an optional payout array: none becomes an empty array."""
    return races.join(payouts, KEY, "left").withColumn(payload, F.coalesce(payload, F.array()))


def races_without_horses(races: DataFrame, horses: DataFrame) -> DataFrame:
    # Only distinct keys travel, combined before the shuffle.
    return races.join(horses.select(*KEY).distinct(), KEY, "left_anti")


def horses_without_race(horses: DataFrame, races: DataFrame) -> DataFrame:
    return skewed_join(horses, races.select(*KEY).distinct(), KEY, "left_anti")


def entries_with_outcomes(
    entries: DataFrame, outcomes: DataFrame, label: Column | None = None
) -> DataFrame:
    """Entries joined to outcomes on key and horse number, to make labels.

    Only the label leaves the outcome side, so no post-race column can reach the features.
    """
    won = F.coalesce(F.col("finish_position") == 1, F.lit(False)).cast("double") if label is None else label
    labels = outcomes.select(*KEY, "horse_no", won.alias("label"))
    return entries.join(labels, [*KEY, "horse_no"], "inner")


def sort_horses(horses: DataFrame, missing: int | None = None) -> DataFrame:
    """By key and horse number, a missing number last (or as `missing`), file order breaking ties."""
    number = F.col("horse_no") if missing is None else F.coalesce("horse_no", F.lit(missing))
    return horses.orderBy(*KEY, number.asc_nulls_last(), "archive", "line_no")


def check_declared_count(races: DataFrame, horses: DataFrame) -> DataFrame:
    """Declared starters against horse rows; an undeclared count is -1, a mismatch."""
    counted = horses.groupBy(*KEY).agg(F.count(F.lit(1)).alias("horse_rows"))
    declared = F.coalesce("declared_count", F.lit(-1))
    return (
        races.join(counted, KEY, "left")
        .select(
            *KEY,
            declared.cast("bigint").alias("declared_count"),
            F.coalesce("horse_rows", F.lit(0).cast("bigint")).alias("horse_rows"),
        )
        .withColumn("pass", F.col("declared_count") == F.col("horse_rows"))
    )


