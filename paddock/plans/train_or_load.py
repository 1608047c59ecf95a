"""Load a saved model when there is one, else train and save; then predict."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.model import load_model, save_model
from paddock.operators.race import KEY
from paddock.operators.scoring import predict
from paddock.operators.training import TrainParams, TrainResult, train
from paddock.plans.race_month import RaceMonth


def train_or_load(df: DataFrame, features: list[str], params: TrainParams, path: str, probe: DataFrame) -> DataFrame:
    """One row (mode, iterations, low, high, separated): the lowest and highest prediction of
    the probe rows with the smallest and largest first feature."""
    spark = df.sparkSession
    try:
        model, mode = load_model(spark, path), "loaded"
    except AnalysisException:
        model, mode = train(df, features, params).model, "trained"
        save_model(spark, model, path)
    first = features[0]
    ends = predict(probe, model).agg(F.min_by("prediction", first).alias("low"), F.max_by("prediction", first).alias("high"))
    return ends.select(
        F.lit(mode).alias("mode"), F.lit(model.iterations).alias("iterations"), "low", "high",
        (F.col("high") > F.col("low")).alias("separated"),
    )


def race_features(month: RaceMonth) -> tuple[DataFrame, list[str]]:
    """Labelled entries with pre-race features only: no outcome column can get in."""
    from paddock.operators.race import entries_with_outcomes, first_per_key

    month = month.kept()
    labelled = entries_with_outcomes(month.entries, month.outcomes)
    race = first_per_key(month.races).select(*KEY, "distance_m", "post_time", "declared_count")
    joined = labelled.join(race, KEY)
    features = ["horse_no", "assigned_weight_kg", "body_weight_kg", "distance_m", "post_time", "declared_count"]
    row_id = F.xxhash64(*KEY, "horse_no", "archive", "line_no")
    return joined.select(row_id.alias("row_id"), "label", *[F.col(f).cast("double").alias(f) for f in features]), features


def train_on_races(month: RaceMonth, params: TrainParams) -> TrainResult:
    df, features = race_features(month)
    return train(df, features, params)
