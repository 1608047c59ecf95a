"""Samples stay bounded when one id, or one row, stands on very many rows; archives of empty pages and repeated tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paddock.llm import language_id, quality_pu, toxicity, warc
from paddock.llm.tables import new_folder


@pytest.fixture(scope="module")
def hot(spark):
    """12,000 rows of id 7, half of them alike, and 600 others."""
    text = F.when(F.col("id") < 6000, F.lit("the same words again")).otherwise(F.concat(F.lit("word number "), F.col("id")))
    rows = spark.range(12_600).select(
        F.when(F.col("id") < 12_000, 7).otherwise(F.col("id")).alias("doc_id"), text.alias("text"),
        F.when(F.col("id") % 20 == 0, F.lit(None)).when(F.col("id") % 21 == 19, F.lit("de")).otherwise(F.lit("en")).alias("lang"),
    )
    return rows.cache()


def _sizes(monkeypatch, module):
    seen = {}
    plain = module.stored

    def counting(df, name):
        out = plain(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(module, "stored", counting)
    return seen


def test_language_sample(spark, hot, monkeypatch):
    seen = _sizes(monkeypatch, language_id)
    model = language_id.fit(hot, F.lit(True), params=language_id.Params(sample_per_language=300, shards=2, epochs=1))
    assert model is not None and 50 < seen["language-sample"] < 700


@pytest.mark.parametrize("marked", [[7], [7, 12_001, 12_002]])
def test_quality_sample(spark, hot, monkeypatch, marked):
    seen = _sizes(monkeypatch, quality_pu)
    labels = spark.createDataFrame([(i, int(i in marked)) for i in (7, 12_001, 12_002, 12_003)], "doc_id long, quality int")
    params = quality_pu.Params(positives=200, unlabelled=400, shards=2, steps=5)
    model, _ = quality_pu.fit(hot, labels, F.lit(True), params=params)
    assert model is not None and 150 < seen["quality-sample"] < 800


def test_severity_sample(spark):
    at, x = F.array(F.when(F.col("id") < 6000, F.lit(0)).otherwise(F.col("id") % 500).cast("long")), F.array(F.lit(1.0))
    graded = spark.range(12_000).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("grade"), at.alias("at"), x.alias("x"))
    params = toxicity.Params(shards=2)
    assert toxicity.training_sample(graded, {0: 1.0, 1: 1.0}, params).count() == 501
    assert toxicity.training_sample(graded, {0: 0.1, 1: 0.1}, params).count() < 120


def test_empty_pages_count_and_tasks_may_run_twice(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(F.col("id") == 5, "x").alias("html"))
    folder = new_folder(spark, "warc-test")
    made = warc.write(pages, folder, params=warc.Params(archive_bytes=200_000))
    first = {r["file"]: tuple(r) for r in made.collect()}
    assert len(first) == 8 and sum(r[1] for r in first.values()) == 3000
    assert {r["file"]: tuple(r) for r in made.collect()} == first
    back = warc.read(spark, folder)
    assert back.count() == 3000 == back.select("page_id").distinct().count()
    with pytest.raises(ValueError):
        warc.write(pages, folder)
