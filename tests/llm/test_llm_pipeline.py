"""The registered queries of the folder and the pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest
from llm_cases import SMALL, documents, messy_rows, rows_of

import __spark_entry__ as entry
from paddock.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    assert entry.queries()[name] is queries.QUERIES[name]
    df = queries.QUERIES[name](spark, SMALL)
    sizes = {"op6": "pages"}
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9"):
        assert df.count() == spark.read.parquet(f"{SMALL}/{sizes.get(name.split('_')[0], 'documents')}.parquet").count()
    else:
        assert df.count() >= 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    assert rows_of(df) == sorted(db.execute(entry.oracle_sql()[name]).fetchall(), key=repr)
    assert df.columns == [d[0] for d in db.description]


def test_pipeline_stages(spark):
    rows = messy_rows(spark, 120)
    docs = documents(spark, rows)
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == before, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
        if name == "near_duplicates":
            assert len(ids & set(range(1200, 1240))) == 1
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    counts = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and last.count() == docs.count()


def test_pipeline_of_nothing(spark):
    docs = documents(spark, messy_rows(spark, 10)).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert rows_of(docs) == []


def test_pipeline_run(spark):
    assert set(corpus_pipeline.run(spark, SMALL).columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}
