"""Rows told apart by file and place, and packed decisions about them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import tables


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.range(100_000).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("__row"), F.lit("x").alias("text")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_rows_have_numbers_of_their_own(spark, docs):
    rows = tables.identified(docs)
    assert rows.columns == ["__row", "__doc"] and rows.select("__row").distinct().count() == 100_000
    one = {r["__row"]: r["id"] for r in rows.select("__row", F.col("__doc.__row").alias("id")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        two = {r["__row"]: r["id"] for r in tables.identified(docs).where("__doc.doc_id = 1").select("__row", F.col("__doc.__row").alias("id")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(two) == 33_333 and all(one[k] == v for k, v in two.items())
    made = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    assert tables.identified(made).select("__row").distinct().count() == 200_000
    assert tables.identified(docs.limit(0)).count() == 0


@pytest.mark.parametrize("packs", [16_384, 1])
def test_times_of_rows(docs, packs):
    rows = tables.identified(docs)
    at = F.col("__doc.__row")
    marks = tables.stored(rows.where(at % 7 < 3).select("__row", (at % 7 + 1).cast("int").alias("times")), "marks")
    got = tables.times_of_rows(rows, marks, 3, packs)
    wanted = F.when(at % 7 < 3, at % 7 + 1).otherwise(0)
    assert got.count() == 100_000 and got.where(F.col("__times") != wanted).isEmpty()


def test_a_stage_deletes_what_the_one_before_left(spark, docs):
    stage = corpus_pipeline.STAGES[-1][1]
    stage(spark, docs, None).count()
    left = list(corpus_pipeline.SCRATCH)
    assert left
    stage(spark, docs, None).count()
    assert not set(left) & set(corpus_pipeline.SCRATCH)
