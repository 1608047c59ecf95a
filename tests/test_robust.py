"""Damaged archives, odd categories, weights and validation of forests and dart."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paddock.operators import binning, bundle, metrics, objectives
from paddock.operators.prefix import weighted_percentile
from paddock.operators.training import TrainParams, train
from paddock.operators.trees import TreeParams
from paddock.sources import archives


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture(scope="module")
def broken(spark):
    good = zipped({"199808_racelist.csv": "a,b\n1,2\n3,4\n", "199808_horselist.csv": "h\n1\n" * 2000, "199808_payback.csv": "p\n"})
    body = bytearray(good)
    at = body.find(b"199808_horselist.csv") + 40
    body[at : at + 6] = b"\xff" * 6
    sealed = bytearray(good)
    for mark, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag that says encrypted
        start = 0
        while (start := sealed.find(mark, start)) >= 0:
            sealed[start + place] |= 1
            start += 4
    rows = [("good", bytearray(good)), ("damaged", body), ("sealed", sealed), ("text", bytearray(b"no archive")), ("cut", bytearray(good[:60]))]
    return spark.createDataFrame(rows, "path string, content binary")


def test_failures_become_error_rows(broken):
    errors = {(r["archive"], r["kind"]) for r in archives.archive_errors(broken).collect()}
    assert {("damaged", "horselist"), ("sealed", "racelist"), ("text", None), ("cut", None)} <= errors
    assert not {a for a, _ in errors} & {"good"}


def test_no_half_members(broken):
    lines = archives.read_archives(broken, 2).groupBy("archive", "kind").count().collect()
    found = {(r["archive"], r["kind"]): r["count"] for r in lines}
    assert found[("good", "horselist")] == 4001 and ("damaged", "horselist") not in found
    assert found[("damaged", "racelist")] == 4 and {a for a, _ in found} == {"good", "damaged"}


def test_counts_of_broken_archives(broken):
    counts = {r["archive"]: (r["racelist"], r["horselist"], r["payback"]) for r in archives.archive_row_counts(broken).collect()}
    assert counts == {"good": (2, 3999, 0), "damaged": (2, -1, 0), "sealed": (-1, -1, -1), "text": (-1, -1, -1), "cut": (-1, -1, -1)}


def test_large_categories(spark):
    df = spark.createDataFrame([(1, 3e9), (2, 4.0), (3, float("nan")), (4, None), (5, -7.0)], "id int, x double")
    spec = binning.FeatureBins("x", "categorical", categories=[4])
    got = {r["id"]: r["b"] for r in df.select("id", binning.value_to_bin(F.col("x"), spec).alias("b")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    found = binning.find_category_bins(df.select(F.lit("x").alias("feature"), F.col("x").alias("value"))).collect()
    assert [(r["category"], r["rows"]) for r in found] == [(4, 1)]
    assert df.where(binning.category_bitset(F.col("x"), [4])).count() == 1


def test_weighted_starts(spark):
    df = spark.createDataFrame([(100.0, 100.0), (0.0, 1.0)], "label double, weight double")
    start = lambda o, **k: objectives.start_score(df, o, objectives.ObjectiveParams(**k), weight="weight").first()["start"]
    assert start("regression") == pytest.approx(10000 / 101)
    assert start("regression_l1") == 100.0 and start("quantile", alpha=0.005) == 0.0
    assert start("mape") == 0.0  # 100 weighs 100 / 100, 0 weighs 1
    assert weighted_percentile(df.select(F.col("label").alias("value"), "weight"), 0.5).first()["value"] == 100.0


def test_bundle_parts_name_the_race_once(spark):
    key = {"track": "t", "race_date": 19980801, "race_no": 1}
    races = spark.createDataFrame([("a", 1, *key.values(), 1200)], "archive string, line_no long, track string, race_date int, race_no int, distance_m int")
    horses = spark.createDataFrame(
        [("a", i, *key.values(), i if i < 10 else None, f"h{i}", "j", 55.0, 440, 1) for i in range(1, 12)],
        "archive string, line_no long, track string, race_date int, race_no int, horse_no int, horse_name string, jockey string, "
        "assigned_weight_kg double, body_weight_kg int, finish_position int",
    )
    paid = spark.createDataFrame([("a", 1, *key.values(), [])], "archive string, line_no long, track string, race_date int, race_no int, slots array<struct<bet_type:string,amount_yen:int,combination:array<int>>>")
    rows = bundle.race_bundle(races, horses, paid, part_rows=4).orderBy("part").collect()
    assert [r["part"] for r in rows] == [0, 1, 2] and [r["race"] is None for r in rows] == [False, True, True]
    assert [r["rejected"] for r in rows] == [2, 0, 0] and sum(len(r["entries"]) for r in rows) == 9


@pytest.fixture(scope="module")
def steps(spark):
    return spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) > 9).cast("double").alias("label"),
        (1.0 + F.col("id") % 3).alias("weight"),
    )


@pytest.mark.parametrize("boosting", ["rf", "dart"])
def test_validation_of_forests_and_dart(steps, boosting):
    p = TrainParams(
        objective="binary", boosting=boosting, num_iterations=3, bagging_freq=1, bagging_fraction=0.7, drop_rate=0.5, skip_drop=0.0,
        bin_construct_sample_cnt=None, tree=TreeParams(num_leaves=3),
    )
    got = train(steps, ["x"], p, valid={"all": steps})
    assert len(got.history) == 3 and set(got.history[0]) == {"all:binary_logloss"}
    from paddock.operators.scoring import predict

    last = metrics.evaluate(predict(steps, got.model), "binary_logloss", weight="weight").first()["value"]
    assert got.history[-1]["all:binary_logloss"] == pytest.approx(last)


def test_early_stop_of_a_forest(steps):
    p = TrainParams(
        objective="binary", boosting="rf", num_iterations=4, bagging_freq=1, bagging_fraction=0.7, early_stopping_round=1,
        early_stopping_min_delta=10.0, bin_construct_sample_cnt=None, tree=TreeParams(num_leaves=3),
    )
    got = train(steps, ["x"], p, valid={"all": steps})
    assert len(got.history) == 2 and got.best_iteration == 1


def test_forest_without_bags_is_refused(steps):
    with pytest.raises(ValueError, match="forest"):
        train(steps, ["x"], TrainParams(objective="binary", boosting="rf", num_iterations=2))


def test_a_batch_is_unzipped_once(spark, tmp_path, monkeypatch):
    """The three tables of a batch are written from one unzipping of its archives."""
    from paddock.sources import archives
    from paddock.streaming import streams

    seen = spark.sparkContext.accumulator(0)
    unzip = archives._unzip

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield from unzip(iter([frame]))

    monkeypatch.setattr(archives, "_unzip", counted)
    body = zipped({"199808_racelist.csv": "a,b\n1,2\n", "199808_horselist.csv": "h\n1\n", "199808_payback.csv": "p\n2\n"})
    schema = "path string, length long, content binary"
    spark.createDataFrame([(f"{i}.zip", len(body), bytearray(body)) for i in range(3)], schema).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.store_archives(files, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert seen.value == 3
    assert spark.read.parquet(str(tmp_path / "out/horses")).count() == 3
