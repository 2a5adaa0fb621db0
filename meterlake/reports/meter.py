"""Comparison of meter types: statistics, distribution shape and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pearson, ratio
from ..operators.joins import meter_pairs
from ..operators.quantiles import grouped_stats

VALUE = "meter_reading"


def sample_skewness(v: Column) -> Column:
    """Bias-corrected skewness; NULL below three values or without spread."""
    n = F.count(v).cast("double")
    return F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(v: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values or without spread."""
    n = F.count(v).cast("double")
    scale = ratio(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(v) + 6))


def compare_meters(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    """Statistics over all present readings of a meter type; std is the population one, readings are timestamps."""
    v = F.col(value)
    stats = grouped_stats(
        df.select("meter", value),
        ["meter"],
        [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")],
        value,
        {"median": 0.5, "q25": 0.25, "q75": 0.75},
        **options,
    )
    buildings = _distinct_per_meter(df, "building_id", "n_buildings")
    times = _distinct_per_meter(df, "timestamp", "n_readings")
    return stats.filter(F.col("mean").isNotNull()).join(buildings, "meter").join(times, "meter")


def _distinct_per_meter(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values per meter type in two steps, so that no task sees all rows of a type."""
    return df.select("meter", column).distinct().groupBy("meter").agg(F.count(column).alias(name))


def meter_distributions(df: DataFrame, value: str = VALUE) -> DataFrame:
    v = F.col(value)
    return (
        df.filter(v.isNotNull())
        .groupBy("meter")
        .agg(
            sample_skewness(v).alias("skewness"),
            sample_kurtosis(v).alias("kurtosis"),
            ratio(F.stddev_pop(v), F.avg(v)).alias("cv"),
            (F.count_if(v == 0) / F.count(F.lit(1)) * 100.0).alias("zero_pct"),
        )
    )


def pair_correlations(df: DataFrame) -> DataFrame:
    """Mean over shared buildings of the Pearson correlation of two meter types."""
    both = meter_pairs(df).filter(F.col("reading_1").isNotNull() & F.col("reading_2").isNotNull())
    per_building = both.groupBy("meter_1", "meter_2", "building_id").agg(
        pearson(F.col("reading_1"), F.col("reading_2")).alias("c"),
        F.count(F.lit(1)).alias("n"),
        (F.min("reading_1") < F.max("reading_1")).alias("moves_1"),
        (F.min("reading_2") < F.max("reading_2")).alias("moves_2"),
    )
    defined = per_building.filter("n > 1 and moves_1 and moves_2")
    return defined.groupBy("meter_1", "meter_2").agg(
        F.avg("c").alias("correlation"), F.count(F.lit(1)).alias("shared_buildings")
    )


def correlated_meters(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return pair_correlations(df).filter(F.col("correlation") > threshold)


def meter_summary(df: DataFrame) -> DataFrame:
    """The meter types and the total number of (type, building) columns."""
    pairs = df.select("meter", "building_id").distinct()
    per_type = pairs.groupBy("meter").agg(F.count("building_id").alias("n"))
    return per_type.agg(
        F.array_join(F.sort_array(F.collect_set("meter")), ",").alias("meter_types_analyzed"),
        F.sum("n").alias("total_buildings"),
    )


def shared_buildings(df: DataFrame, first: str, second: str) -> DataFrame:
    """Buildings that have both meter types."""
    def of(meter: str) -> DataFrame:
        return df.filter(F.col("meter") == meter).select("building_id")

    return of(first).intersect(of(second))


def meter_report(df: DataFrame, value: str = VALUE, threshold: float = 0.7, **options) -> dict[str, DataFrame]:
    return {
        "meter_comparison": compare_meters(df, value, **options),
        "distributions": meter_distributions(df, value),
        "correlations": correlated_meters(df, threshold),
        "summary": meter_summary(df),
    }
