"""The corpus pipeline: language identification, near-duplicate removal, benchmark
decontamination, source mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of `docs`;
the last adds `shard` and `slot`. Stages are written as Parquet and read again in between.

Defined results: empty input gives empty output at every stage. Null and blank texts end at
the first stage, as no language can be told. From the second stage on, rows are told apart by
their file and place in it, so null and repeated ids change nothing but order. Columns beside those of `documents`
pass through untouched, whatever their names, except `shard` and `slot` in the last stage.

What a stage writes in between is deleted when the next stage (of this session) begins, unless the
rows handed to that stage are still read from it: by then its own result is written.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import decontamination, language_id, mixing, ngram_join, sharding
from paddock.llm.tables import discard, fold, noted, stored, table

# Folders of the stage that ran last.
SCRATCH: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    @functools.wraps(run)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = " ".join(docs.inputFiles())
        kept = [path for path in SCRATCH if path.rsplit("/", 1)[1] in read]
        for path in set(SCRATCH) - set(kept):
            discard(spark, path)
        SCRATCH[:] = kept
        with noted(SCRATCH):
            return run(spark, docs, sf_dir)

    return tidy


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `und` ones go."""
    model = language_id.fit(docs, fold("doc_id", 3) != 1)
    # A row travels as one struct, so no column of it can clash with what is found.
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    found = language_id.identify(rows, model, ["row"])
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select("row.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each class of the n-gram Jaccard join (five words, 0.8)."""
    return ngram_join.one_row_of_each(docs, params=ngram_join.Params(width=5, percent=80))


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the schedule plays them."""
    return mixing.mixed_documents(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it."""
    return sharding.with_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

# Language scores come from an iteratively trained model, so SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
