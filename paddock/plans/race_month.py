"""From raw CSV lines of the three tables to typed races, horses, paybacks and bundles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import bundle, payouts, race
from paddock.session import written
from paddock.sources.archives import csv_table, dealt_pieces, piece_lines

FILE = ["archive", "yyyymm", "kind"]


class RaceMonth:
    """Typed tables of one or many months; each is planned when first used."""

    def __init__(self, racelist: DataFrame, horselist: DataFrame, payback: DataFrame, file_columns: list[str]):
        self._lines = (racelist, horselist, payback)
        self._file = file_columns

    @cached_property
    def races(self) -> DataFrame:
        return race.map_race(csv_table(self._lines[0], self._file))

    @cached_property
    def horses(self) -> DataFrame:
        return race.map_horses(csv_table(self._lines[1], self._file))

    @cached_property
    def paybacks(self) -> DataFrame:
        return payouts.map_paybacks(csv_table(self._lines[2], self._file))

    def kept(self) -> RaceMonth:
        """This month with its horses written and read again, for work that needs them more than once."""
        month = RaceMonth(*self._lines, self._file)
        month.horses = written(self.horses)
        return month

    @property
    def entries(self) -> DataFrame:
        return race.map_entries(self.horses)

    @property
    def outcomes(self) -> DataFrame:
        return race.map_outcomes(self.horses)

    @property
    def payouts(self) -> DataFrame:
        """Payouts of the first payback row of each key, as the one-race mapping takes it."""
        read = payouts.payback_numbers(csv_table(self._lines[2], self._file))
        return payouts.unpivot_payouts(payouts.with_slots(race.first_per_key(read)))

    def bundles(self) -> DataFrame:
        return bundle.race_bundle(self.races, self.horses, self.paybacks)

    def card(self) -> DataFrame:
        first = race.first_per_key(self.races)
        known = race.filter_races(self.horses, first.select(*race.KEY))
        return bundle.race_card(first, known, self.payouts)


def from_archives(files: DataFrame) -> RaceMonth:
    """`archive_files` rows to typed tables. Write the lines to Parquet first when the
    tables are used more than once: unzipping cannot skip anything."""
    return from_pieces(dealt_pieces(files))


def from_pieces(pieces: DataFrame) -> RaceMonth:
    """`dealt_pieces` rows to typed tables."""
    lines = piece_lines(pieces)
    return RaceMonth(*[lines.where(F.col("kind") == k) for k in ("racelist", "horselist", "payback")], FILE)


def write_typed(month: RaceMonth, path: str, batch: int | None = None) -> None:
    """Typed tables as Parquet, partitioned by month so later reads prune; of a batch, under its number."""
    under = "" if batch is None else f"/batch={batch}"
    month_column = (F.col("race_date") / 100).cast("int").alias("yyyymm")
    for name, frame in (("races", month.races), ("horses", month.horses), ("payouts", month.payouts)):
        frame.select("*", month_column).write.mode("overwrite").partitionBy("yyyymm").parquet(f"{path}/{name}{under}")
