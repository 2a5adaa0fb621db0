"""Forecasts that need no training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.windows import add_temporal_features


def weekly_naive(df: DataFrame, target: str = "meter_reading", group_cols: Sequence[str] = ("building_id",), **options) -> DataFrame:
    """The value of the same hour last week."""
    out = add_temporal_features(df, target, (168,), (), group_cols=group_cols, **options)
    return out.withColumnRenamed(f"{target}_lag_168h", "prediction")


def rolling_mean(
    df: DataFrame, target: str = "meter_reading", window: int = 24, group_cols: Sequence[str] = ("building_id",), **options
) -> DataFrame:
    """The mean of the previous hours."""
    out = add_temporal_features(df, target, (), ((window, ("mean",)),), group_cols=group_cols, **options)
    return out.withColumnRenamed(f"{target}_rolling_{window}h_mean", "prediction")
