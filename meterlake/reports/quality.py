"""Data-quality figures: missing columns, run summaries, timestamp continuity, and the check table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pearson, share
from ..operators.cleaning import duplicate_keys, outlier_bounds
from ..operators.quantiles import grouped_stats
from ..operators.windows import gap_intervals

VALUE = "meter_reading"


def column_missing(df: DataFrame, above: float | None = 10.0) -> DataFrame:
    """Percentage of NULLs per column in one pass; only columns above the limit (None: all)."""
    wide = df.agg(*[share(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_pct")) for c in df.columns])
    tall = wide.select(F.explode(pairs).alias("p")).select("p.*")
    return tall if above is None else tall.filter(F.col("missing_pct") > above)


def run_summary(df: DataFrame, value: str = VALUE, **options) -> DataFrame:
    """Rows, columns, buildings, sites, time bounds, mean and median reading."""
    per_building = df.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_building.agg(F.count("building_id").alias("buildings"))
    out = grouped_stats(
        df.select("timestamp", value),
        [],
        [
            F.count(F.lit(1)).alias("rows"),
            F.min("timestamp").alias("start"),
            F.max("timestamp").alias("end"),
            F.avg(value).alias("mean_reading"),
        ],
        value,
        {"median_reading": 0.5},
        **options,
    )
    out = out.withColumn("columns", F.lit(len(df.columns))).withColumn("buildings", counts.scalar())
    if "site_id" in df.columns:
        sites = df.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count("site_id").alias("sites"))
        out = out.withColumn("sites", sites.scalar())
    return out


def split_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows, share and time bounds of both sides of a split."""
    both = train.select("timestamp", F.lit("train").alias("part")).unionByName(
        test.select("timestamp", F.lit("test").alias("part"))
    )
    per_part = both.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )
    total = per_part.agg(F.sum("rows")).scalar()
    return per_part.withColumn("row_pct", F.col("rows") / total * 100.0)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values per column: one two-step distinct per column."""
    counts = [
        df.select(F.col(c).alias("v")).distinct().agg(F.lit(c).alias("column"), F.count("v").alias("distinct_values"))
        for c in columns
    ]
    return reduce(DataFrame.unionByName, counts)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_1, column_2, correlation) for all pairs, from one aggregate over the rows."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(f"c{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def continuity(df: DataFrame, group_cols: Sequence[str] = (), time_col: str = "timestamp", step: str = "1 hour") -> DataFrame:
    """Expected, actual, missing and extra timestamps, for the table or per group.

    The expected ones are start, start + step, ... up to the end, that is those with the phase (position within a step)
    of the first one. Counting per phase decides it without expanding the grid.
    """
    groups = list(group_cols)
    width = _step_micros(step)
    times = df.select(*groups, F.col(time_col).alias("__t")).filter("__t is not null").distinct()
    per_phase = times.groupBy(*groups, F.pmod(_micros(F.col("__t")), F.lit(width)).alias("__phase")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_micros(F.col("__t"))).alias("__lo"), F.max(_micros(F.col("__t"))).alias("__hi")
    )
    counted = per_phase.groupBy(*groups).agg(
        F.expr(f"(max(__hi) - min(__lo)) div {width} + 1").alias("expected_count"),
        F.sum("__n").alias("actual_count"),
        F.min_by("__n", "__lo").alias("__on"),
    )
    return counted.filter("actual_count > 0").select(
        *groups,
        "expected_count",
        "actual_count",
        (F.col("expected_count") - F.col("__on")).alias("missing_count"),
        (F.col("actual_count") - F.col("__on")).alias("extra_count"),
        (F.col("actual_count") / F.col("expected_count") * 100.0).alias("completeness"),
    )


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _step_micros(step: str) -> int:
    count, unit = step.split()
    return int(count) * _UNITS[unit.rstrip("s")] * 1_000_000


def expected_timestamps(df: DataFrame, time_col: str = "timestamp", step: str = "1 hour") -> DataFrame:
    span = df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))
    return span.select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(time_col))


def missing_timestamps(df: DataFrame, time_col: str = "timestamp", step: str = "1 hour") -> DataFrame:
    """Expected timestamps without a row."""
    return expected_timestamps(df, time_col, step).join(df.select(time_col), time_col, "left_anti")


def extra_timestamps(df: DataFrame, time_col: str = "timestamp", step: str = "1 hour") -> DataFrame:
    """Distinct timestamps that are not expected."""
    return df.select(time_col).subtract(expected_timestamps(df, time_col, step))


def gap_summary(
    df: DataFrame, group_cols: Sequence[str] = ("building_id",), time_col: str = "timestamp", step: str = "1 hour", **options
) -> DataFrame:
    """Number of gaps, missing steps, and length and start of the longest gap (the earliest of equals) per group with gaps."""
    gaps = gap_intervals(df, group_cols, time_col, step, **options)
    longest = F.min_by("gap_start", F.struct(-F.col("missing_steps"), F.col("gap_start")))
    return gaps.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("gaps"),
        F.sum("missing_steps").alias("missing_steps"),
        F.max("missing_steps").alias("longest_gap"),
        longest.alias("longest_gap_start"),
    )


def missing_times_by_group(
    df: DataFrame, group_cols: Sequence[str] = ("building_id",), time_col: str = "timestamp", step: str = "1 hour", **options
) -> DataFrame:
    """Every missing time of a group, expanded from its gaps alone, without a join to the readings."""
    gaps = gap_intervals(df, group_cols, time_col, step, **options)
    return gaps.select(*group_cols, F.explode(F.expr(f"sequence(gap_start, gap_end, interval {step})")).alias(time_col))


def quality_checks(
    df: DataFrame, expected_columns: Sequence[str], max_missing: float = 0.3, max_duplicates: float = 0.01
) -> DataFrame:
    """One row per check with its observed figure, its limit and whether it passes."""
    absent = [c for c in expected_columns if c not in df.columns]
    v = F.col(VALUE)
    bounds = outlier_bounds(df).select(F.struct("lower_bound", "upper_bound")).scalar()
    low, high = bounds["lower_bound"], bounds["upper_bound"]
    per_key = df.groupBy(*duplicate_keys(df)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v.isNull()).alias("null"),
        F.count_if(v < 0).alias("neg"),
        F.count_if((v < low) | (v > high)).alias("out"),
    )
    figures = per_key.agg(
        F.sum("n").alias("n"),
        (F.sum("null") / F.sum("n")).alias("missing_values"),
        (F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_rows"),
        F.sum("neg").cast("double").alias("negative_readings"),
        F.sum("out").cast("double").alias("outliers"),
    )
    gaps = continuity(df).select(F.col("missing_count").cast("double")).scalar()
    figures = figures.withColumns({"timestamp_gaps": gaps, "schema_validation": F.lit(float(len(absent)))})
    limits = {
        "schema_validation": 0.0,
        "missing_values": max_missing,
        "duplicate_rows": max_duplicates,
        "timestamp_gaps": 0.0,
        "negative_readings": 0.0,
        "outliers": 0.0,
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(name).alias("observed"), F.lit(limit).alias("limit"))
            for name, limit in limits.items()
        ]
    )
    return (
        figures.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("passed", F.col("observed") <= F.col("limit"))
    )
