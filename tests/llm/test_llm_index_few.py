"""The multi-index returns k rows of other ids, or all, with the default parameters."""

from pyspark.sql import functions as F

from paddock.llm import multi_index


def _found(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return [r["vec_id"] for r in multi_index.search(vectors, F.col("vec_id") == 0).orderBy("rank").collect()]


def test_few_candidates_are_all_returned(spark):
    for n in (2, 8, 11, 14):
        found = _found(spark, [(i, [float(i + 1), 0.0, 0.0, float(i * i)]) for i in range(n)])
        assert found == list(range(1, n))[:10]


def test_rows_of_the_own_id_fill_no_cell(spark):
    rows = [(0, [1.0, 0.0, 0.0, 1.0 + k / 1000]) for k in range(40)] + [(i, [float(10 * i), 0.0, 0.0, float(i * i)]) for i in range(1, 13)]
    assert _found(spark, rows) == list(range(1, 11))
