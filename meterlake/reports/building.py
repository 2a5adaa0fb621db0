"""Per-building statistics and their roll-ups by use type and site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.physical import parse_building_id
from ..operators.quantiles import grouped_stats

VALUE = "meter_reading"


def parsed_buildings(df: DataFrame) -> DataFrame:
    """Distinct buildings with the parts of their ids."""
    return df.select("building_id").distinct().withColumns(parse_building_id(F.col("building_id")))


def building_stats(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    """Location, spread and completeness per building.

    missing_pct relates missing readings to present ones, so it may exceed 100; missing_share relates them to all rows.
    """
    v = F.col(value)
    stats = grouped_stats(
        df.select("building_id", value),
        ["building_id"],
        [
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.count(v).alias("count"),
            F.count_if(v.isNull()).alias("missing_count"),
        ],
        value,
        {"median": 0.5, "q25": 0.25, "q75": 0.75},
        **options,
    )
    missing, present = F.col("missing_count"), F.col("count")
    return stats.withColumns(
        {
            "missing_pct": ratio(missing, present) * 100.0,
            "missing_share": ratio(missing, missing + present),
            "cv": ratio(F.col("std"), F.col("mean")),
            "range": F.col("max") - F.col("min"),
            "iqr": F.col("q75") - F.col("q25"),
        }
    )


def with_parsed_ids(stats: DataFrame) -> DataFrame:
    """Statistics with site, use type and name. The parts are a function of the id, so no join is needed."""
    return stats.withColumns(parse_building_id(F.col("building_id")))


def by_use_type(stats: DataFrame) -> DataFrame:
    return (
        with_parsed_ids(stats)
        .groupBy("use_type")
        .agg(
            F.avg("mean").alias("mean_mean"),
            F.stddev_samp("mean").alias("mean_std"),
            F.count("mean").alias("mean_count"),
            F.avg("median").alias("median_mean"),
            F.avg("cv").alias("cv_mean"),
        )
    )


def by_site(stats: DataFrame) -> DataFrame:
    return (
        with_parsed_ids(stats)
        .groupBy("site")
        .agg(
            F.avg("mean").alias("mean_mean"),
            F.stddev_samp("mean").alias("mean_std"),
            F.count("mean").alias("mean_count"),
            F.avg("median").alias("median_mean"),
        )
    )


def value_counts(stats: DataFrame, column: str) -> DataFrame:
    """Buildings per use type or site."""
    return with_parsed_ids(stats).groupBy(column).agg(F.count(F.lit(1)).alias("buildings"))


def extremes(groups: DataFrame, key: str) -> DataFrame:
    """The group with the highest and the lowest mean of means; ties go to the smaller name."""
    k, m = F.col(key), F.col("mean_mean")
    return groups.filter(m.isNotNull()).agg(
        F.min(F.struct((-m).alias("m"), k.alias("k")))["k"].alias(f"highest_consumption_{key}"),
        F.min(F.struct(m.alias("m"), k.alias("k")))["k"].alias(f"lowest_consumption_{key}"),
    )


def high_variance(stats: DataFrame, threshold: float = 1.0) -> DataFrame:
    return stats.filter(F.col("cv") > threshold).select("building_id", "cv")


def building_summary(stats: DataFrame, **options) -> DataFrame:
    return grouped_stats(
        with_parsed_ids(stats).select("mean", "median", "site", "use_type"),
        [],
        [
            F.count(F.lit(1)).alias("total_buildings"),
            F.count_distinct("site").alias("unique_sites"),
            F.count_distinct("use_type").alias("unique_use_types"),
            F.avg("mean").alias("avg_consumption"),
        ],
        "median",
        {"median_consumption": 0.5},
        **options,
    )


def building_report(df: DataFrame, value: str = VALUE, **options) -> dict[str, DataFrame]:
    stats = building_stats(df, value, **options)
    uses, sites = by_use_type(stats), by_site(stats)
    return {
        "building_statistics": stats,
        "use_type_stats": uses,
        "use_type_counts": value_counts(stats, "use_type"),
        "use_type_extremes": extremes(uses, "use_type"),
        "site_stats": sites,
        "site_counts": value_counts(stats, "site"),
        "site_extremes": extremes(sites, "site"),
        "high_variance_buildings": high_variance(stats),
        "summary": building_summary(stats),
    }
