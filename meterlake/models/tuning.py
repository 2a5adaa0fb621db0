"""Grid search over time folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import evaluate


def tune_over_folds(
    df: DataFrame,
    folds: DataFrame,
    grid: Sequence[dict],
    scored: Callable[[DataFrame, DataFrame, dict], DataFrame],
    target: str,
    time_col: str = "timestamp",
) -> DataFrame:
    """(fold, grid_point, params, metrics) for every combination.

    ``scored(train, test, params)`` fits on the training rows and returns the test rows with a prediction column. As in
    Spark's own cross-validation, the driver loops over combinations and every fit is a distributed job; only one row of
    metrics per combination comes back.
    """
    month = F.year(time_col) * 12 + F.month(time_col) - 1
    found, schema = [], None
    for fold in folds.orderBy("fold").collect():
        train = df.filter(month.between(fold["train_from"], fold["train_to"]))
        test = df.filter(month.between(fold["test_from"], fold["test_to"]))
        for i, params in enumerate(grid):
            metrics = evaluate(scored(train, test, params), target, "prediction")
            row = metrics.select(
                F.lit(fold["fold"]).alias("fold"), F.lit(i).alias("grid_point"), F.lit(str(params)).alias("params"), "*"
            )
            found, schema = found + row.collect(), row.schema
    return df.sparkSession.createDataFrame(found, schema)
