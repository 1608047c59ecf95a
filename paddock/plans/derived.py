"""Race CSV text rendered from the given tables: orders play races, line items play horses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators.payouts import BETS
from paddock.operators.race import HORSE_COLUMNS, KEY_COLUMNS, RACE_COLUMNS
from paddock.plans.catalog import table
from paddock.plans.race_month import RaceMonth
from paddock.session import parallelism


# Header of each kind of file.
HEADERS = {
    "racelist": [*KEY_COLUMNS, *RACE_COLUMNS.values()],
    "horselist": [*KEY_COLUMNS, *HORSE_COLUMNS.values()],
    "payback": [*KEY_COLUMNS, *[name for _, amount, numbers in BETS for name in (amount, *numbers)]],
}


def _with_header(data: DataFrame, orders: DataFrame, header: list[str]) -> DataFrame:
    """Lines of a rendered file as `read_archives` gives them: a blank line and a header
    line come first, and every line carries its file's header. The files are the orders'
    priorities, so no line is rendered to know them."""
    files = orders.select(F.col("o_orderpriority").alias("archive")).distinct()
    text = "﻿" + ",".join(header)
    lines = files.select("archive", F.posexplode(F.array(F.lit("　 "), F.lit(text))).alias("pos", "line"))
    # Rendered once a row: no condition on a line is pushed below a generator.
    rendered = data.select("archive", "line_no", F.explode(F.array("line")).alias("line"))
    headed = lines.select("archive", (F.col("pos") - 2).cast("long").alias("line_no"), "line").unionByName(rendered)
    positions = F.create_map(*[F.lit(x) for i, name in enumerate(header) for x in (name, i)])
    return headed.select("*", F.lit(-1).cast("long").alias("header_line"), positions.alias("header"))


def _spread(df: DataFrame) -> DataFrame:
    """Small tables come in few input splits; real text would arrive in many. Large ones are split as it is."""
    spark = df.sparkSession
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(parallelism(spark))


def _line(*fields: Column) -> Column:
    return F.concat_ws(",", *[f.cast("string") for f in fields])


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy/MM/dd")


def race_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _spread(table(spark, sf_dir, "orders"))
    line = _line(
        F.col("o_orderstatus"),
        _day("o_orderdate"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("R")),
        F.concat(F.lit("12:"), (F.col("o_custkey") % 50 + 10).cast("string")),
        F.concat(F.floor("o_totalprice").cast("string"), F.lit("m")),
        F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""dry"""')),
        F.concat(F.lit("　"), F.col("o_orderstatus"), F.lit("　 ")),
        (F.col("o_orderkey") % 8).cast("string"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" 　")).otherwise(
            F.concat(F.lit("race "), F.col("o_custkey").cast("string"))
        ),
    )
    data = o.select(F.col("o_orderpriority").alias("archive"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return _with_header(data, table(spark, sf_dir, "orders"), HEADERS["racelist"])


def horse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
        )
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    line = _line(
        F.col("o_orderstatus"),
        _day("o_orderdate"),
        F.col("l_orderkey"),
        F.translate(F.col("l_linenumber").cast("string"), "0123456789", "０１２３４５６７８９"),
        F.concat(F.lit("horse "), F.col("l_partkey").cast("string")),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("rider "), F.col("l_suppkey").cast("string"))),
        F.concat(F.col("l_quantity").cast("string"), F.lit("kg")),
        F.concat((F.col("l_suppkey") + 400).cast("string"), F.lit("(+2)")),
        F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise((F.col("l_partkey") % 12 + 1).cast("string")),
    )
    data = rows.select(
        F.col("o_orderpriority").alias("archive"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("line_no"),
        line.alias("line"),
    )
    return _with_header(data, o, HEADERS["horselist"])


def bet_amount(slot: int) -> Column:
    return (F.col("o_orderkey") * (slot + 2) + F.col("o_custkey")) % 97 * 10


def bet_number(slot: int, j: int) -> Column:
    return (F.col("o_orderkey") * slot + F.col("o_custkey") * j) % 19


def payback_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _spread(table(spark, sf_dir, "orders"))
    values = []
    for slot, (_, _, numbers) in enumerate(BETS, start=1):
        values.append(F.concat(bet_amount(slot).cast("string"), F.lit("円")))
        for j in range(1, len(numbers) + 1):
            n = bet_number(slot, j)
            values.append(F.when(n == 0, F.lit("")).otherwise(n.cast("string")))
    line = _line(F.col("o_orderstatus"), _day("o_orderdate"), F.col("o_orderkey"), *values)
    data = o.select(F.col("o_orderpriority").alias("archive"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return _with_header(data, table(spark, sf_dir, "orders"), HEADERS["payback"])


def derived_month(spark: SparkSession, sf_dir: str) -> RaceMonth:
    return RaceMonth(
        race_csv(spark, sf_dir), horse_csv(spark, sf_dir), payback_csv(spark, sf_dir), ["archive"]
    )
