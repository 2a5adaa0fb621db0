"""Load profiles by hour, weekday, month and quarter, and hour-of-day anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import profile_columns
from ..functions.columns import ratio
from ..operators.quantiles import grouped_stats

VALUE = "meter_reading"


def _profile(df: DataFrame, part: str, value: str, extremes: bool, **options) -> DataFrame:
    keyed = df.select(profile_columns(F.col("timestamp"))[part].alias(part), F.col(value))
    aggregates = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    if extremes:
        aggregates += [F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")]
    return grouped_stats(keyed, [part], aggregates, value, {"median": 0.5}, **options)


def hourly_stats(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    return _profile(df, "hour", value, True, **options)


def daily_stats(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    return _profile(df, "day_of_week", value, False, **options)


def monthly_stats(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    return _profile(df, "month", value, False, **options)


def quarterly_stats(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    return _profile(df, "quarter", value, False, **options)


def _means(df: DataFrame, part: str, value: str) -> DataFrame:
    """Group means only; the summaries need no medians."""
    return df.groupBy(profile_columns(F.col("timestamp"))[part].alias(part)).agg(F.avg(value).alias("mean"))


def _arg_extremes(means: DataFrame, part: str, *extra) -> DataFrame:
    """Groups with the largest and smallest mean (ties: smallest key) and the sample std of the means."""
    known = means.filter(F.col("mean").isNotNull())
    key, mean = F.col(part), F.col("mean")
    return known.agg(
        F.max_by(key, F.struct(mean, -key)).alias(f"peak_{part}"),
        F.min_by(key, F.struct(mean, key)).alias(f"low_{part}"),
        *extra,
    )


def hourly_summary(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Peak and low hour with their means; hourly_variance is the std of the hourly means."""
    return _arg_extremes(
        _means(df, "hour", value),
        "hour",
        F.max("mean").alias("peak_consumption"),
        F.min("mean").alias("low_consumption"),
        F.stddev_samp("mean").alias("hourly_variance"),
    )


def seasonal_summary(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Peak and low month; seasonal_variance is the std of the monthly means."""
    return _arg_extremes(
        _means(df, "month", value), "month", F.stddev_samp("mean").alias("seasonal_variance")
    )


def weekend_summary(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Weekday and weekend means and their ratio; 0 unless the weekday mean is positive."""
    weekend = F.weekday("timestamp") >= 5
    means = df.agg(
        F.avg(F.when(~weekend, F.col(value))).alias("weekday_average"),
        F.avg(F.when(weekend, F.col(value))).alias("weekend_average"),
    )
    quotient = ratio(F.col("weekend_average"), F.col("weekday_average"))
    return means.withColumn("weekend_ratio", F.when(F.col("weekday_average") > 0, quotient).otherwise(F.lit(0.0)))


def temporal_summary(df: DataFrame) -> DataFrame:
    """Row count, time span in whole days and number of buildings."""
    per_building = df.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return (
        per_building.agg(
            F.sum("n").alias("total_records"),
            F.min("lo").alias("start"),
            F.max("hi").alias("end"),
            F.count("building_id").alias("unique_buildings"),
        )
        .withColumn("days", F.floor(seconds / 86400))
    )


def detect_anomalies(df: DataFrame, method: str = "statistical", value: str = VALUE, k: float = 3.0) -> DataFrame:
    """Rows with is_anomaly: further than k standard deviations from the mean of their hour of day.

    The statistics are 24 rows, computed with partial aggregation and broadcast; no window gathers an hour's rows.
    """
    hour = F.hour("timestamp")
    per_hour = df.groupBy(hour.alias("__hour")).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    joined = df.withColumn("__h", hour).join(F.broadcast(per_hour), F.col("__h") == F.col("__hour"), "left")
    v, m, s = F.col(value), F.col("__m"), F.col("__s")
    if method == "statistical":
        flag = F.abs(ratio(v - m, s)) > k
    else:
        flag = (v > m + s * k) | (v < m - s * k)
    return joined.select(*df.columns, F.coalesce(flag, F.lit(False)).alias("is_anomaly"))


def temporal_report(df: DataFrame, value: str = VALUE, **options) -> dict[str, DataFrame]:
    """One tidy table per section."""
    return {
        "hourly_stats": hourly_stats(df, value, **options),
        "hourly_summary": hourly_summary(df, value),
        "daily_stats": daily_stats(df, value, **options),
        "weekend_summary": weekend_summary(df, value),
        "monthly_stats": monthly_stats(df, value, **options),
        "quarterly_stats": quarterly_stats(df, value, **options),
        "seasonal_summary": seasonal_summary(df, value),
        "summary": temporal_summary(df),
    }
