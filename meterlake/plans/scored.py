"""Queries over the scored table: pick a building, its R2, its forecast series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..models.metrics import building_r2
from ..operators.features import where_equal

PREDICTIONS = ("predicted_trees", "predicted_additive")


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def series(scored: DataFrame, building_id: str, predictions: Sequence[str] = PREDICTIONS) -> DataFrame:
    """Actual and predicted values of one building in time order; the filter reaches the scan."""
    return where_equal(scored, {"building_id": building_id}).select("timestamp", "actual", *predictions).orderBy("timestamp")


def score_buildings(scored: DataFrame, predictions: Sequence[str] = PREDICTIONS) -> DataFrame:
    return building_r2(scored, "actual", predictions)
