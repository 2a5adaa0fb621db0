"""Regression metrics as one mergeable aggregate, for the whole table or any slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import season
from ..functions.columns import at_least, ratio


def metric_columns(actual: Column, predicted: Column) -> list[Column]:
    """RMSE, MAE, RMSLE (both sides clipped at zero), R2 and MAPE (rows with a non-zero actual)."""
    zero = F.lit(0.0)
    error = actual - predicted
    log_error = F.log1p(at_least(actual, zero)) - F.log1p(at_least(predicted, zero))
    rows = F.count(error)
    sse = F.sum(error * error)
    sst = F.var_pop(actual) * rows
    r2 = (
        F.when(rows < 2, None)
        .when(sst > 0, 1.0 - ratio(sse, sst))
        .when(sse == 0, F.lit(1.0))
        .otherwise(zero)
    )
    return [
        rows.alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(log_error * log_error)).alias("rmsle"),
        r2.alias("r2"),
        (F.avg(F.when(actual != 0, F.abs(ratio(error, actual)))) * 100.0).alias("mape"),
    ]


def evaluate(df: DataFrame, actual: str, predicted: str, by: Sequence[str | Column] = ()) -> DataFrame:
    """Metrics over the rows that have both an actual and a predicted value, per slice if given."""
    both = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(*by).agg(*metric_columns(F.col(actual), F.col(predicted)))


def building_r2(df: DataFrame, actual: str, predictions: Sequence[str]) -> DataFrame:
    """R2 of each prediction column per building, in one pass."""
    return df.groupBy("building_id").agg(
        *[metric_columns(F.col(actual), F.col(p))[4].alias(f"r2_{p}") for p in predictions]
    )


def temperature_band(temperature: Column, low: float = -20.0, high: float = 40.0, bands: int = 6) -> Column:
    """Equal-width temperature bands; 0 and bands + 1 lie outside the range."""
    return F.width_bucket(temperature, F.lit(low), F.lit(high), F.lit(bands))


def slice_columns(df: DataFrame, time_col: str = "timestamp") -> dict[str, Column]:
    """The evaluation slices whose columns are present."""
    ts = F.col(time_col)
    slices = {
        "season": season(F.month(ts)),
        "hour": F.hour(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }
    if "meter" in df.columns:
        slices["meter"] = F.col("meter")
    if "primary_use" in df.columns:
        slices["primary_use"] = F.col("primary_use")
    if "air_temperature" in df.columns:
        slices["temperature_band"] = temperature_band(F.col("air_temperature"))
    return slices


def evaluate_slices(df: DataFrame, actual: str, predicted: str, slices: dict[str, Column] | None = None) -> DataFrame:
    """Metrics of every slice as (slice, slice_value, ...). The rows are read once, by grouping sets."""
    slices = slice_columns(df) if slices is None else slices
    both = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(
        F.col(actual).alias("__a"),
        F.col(predicted).alias("__p"),
        *[column.cast("string").alias(name) for name, column in slices.items()],
    )
    names = list(slices)
    keys = [F.col(n) for n in names]
    grouped = both.groupingSets([[k] for k in keys], *keys).agg(
        *metric_columns(F.col("__a"), F.col("__p")), *[F.grouping(n).alias(f"__g_{n}") for n in names]
    )
    which = F.coalesce(*[F.when(F.col(f"__g_{n}") == 0, F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col(f"__g_{n}") == 0, F.col(n)) for n in names])
    return grouped.select(which.alias("slice"), value.alias("slice_value"), "n", "rmse", "mae", "rmsle", "r2", "mape")


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def residual_histogram(df: DataFrame, actual: str, predicted: str, width: float) -> DataFrame:
    """Counts of residuals per bin of the given width; residual_from is the bin's lower edge."""
    binned = F.floor((F.col(actual) - F.col(predicted)) / width) * F.lit(width)
    return (
        df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(binned.alias("residual_from"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
