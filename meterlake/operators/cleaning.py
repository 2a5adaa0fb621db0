"""Row filters, duplicate removal, outlier handling and building exclusion for long readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import at_least, clip, share
from ..functions.physical import building_age, log_area, tidy_category
from ..session import cut_lineage
from ..schemas import METER_CODES, has_columns, numeric_columns
from .quantiles import grouped_stats
from .skew import HOT_ROWS, first_per_key, fits, needs_split
from .windows import fill_gaps

VALUE = "meter_reading"


def keep_non_negative(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Drop negative readings, keep missing ones."""
    return df.filter(F.col(value).isNull() | (F.col(value) >= 0))


def drop_zeros(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Drop zero readings, keep missing ones."""
    return df.filter(F.col(value).isNull() | (F.col(value) != 0))


def handle_negatives(
    df: DataFrame, action: str = "remove", drop_nulls: bool = False, value: str = VALUE
) -> DataFrame:
    """Remove negative readings or set them to zero. ``drop_nulls`` also drops missing ones when removing."""
    if action == "remove":
        return df.filter(F.col(value) >= 0) if drop_nulls else keep_non_negative(df, value)
    return df.withColumn(value, at_least(F.col(value), F.lit(0.0)))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def duplicate_keys(df: DataFrame) -> list[str]:
    return ["building_id", "timestamp"] + (["meter"] if "meter" in df.columns else [])


def drop_duplicates(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Keep the first row in file order per key."""
    return first_per_key(df, list(keys or duplicate_keys(df)), list(order))


def with_file_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """An ordinal that follows the input files: path, start of the block, place in the block.

    Spark packs blocks into partitions by size, so row ids alone follow no file order; they only order the rows of one
    block here. Rows that come from no file are ordered by row id. Add filters first: they don't pass the ordinal.
    """
    if name in df.columns:
        return df
    place = F.monotonically_increasing_id().alias("place")
    try:
        return df.withColumn(name, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), place))
    except AnalysisException:
        return df.withColumn(name, F.struct(place))


def clean_readings(
    df: DataFrame,
    remove_negatives: bool = True,
    remove_zeros: bool = False,
    keys: Sequence[str] | None = None,
    observation: Observation | None = None,
    co_locate: Sequence[str] = (),
) -> DataFrame:
    """Filters, then first-in-file duplicate removal. ``observation`` collects the row counts on the way.

    ``co_locate``, a subset of the keys, shuffles the rows by these columns only, so that later windows over them need no
    shuffle of their own. Only for columns without hot groups.
    """
    if observation is not None:
        v = F.col(VALUE)
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("initial_rows"),
            F.count_if(v < 0).alias("negatives"),
            F.count_if(v == 0).alias("zeros"),
            F.count_if(v.isNull()).alias("missing"),
        )
    if remove_negatives:
        df = keep_non_negative(df)
    if remove_zeros:
        df = drop_zeros(df)
    df = with_file_order(df)
    if co_locate:
        df = df.repartition(*co_locate)
    return drop_duplicates(df, keys)


def cleaning_counts(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row of before/after counts of the default cleaning."""
    v = F.col(VALUE)
    per_key = df.groupBy(*(keys or duplicate_keys(df))).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v < 0).alias("neg"),
        F.count_if(v == 0).alias("zero"),
        F.count_if(v.isNull()).alias("null"),
    )
    kept = F.col("n") - F.col("neg")
    totals = per_key.agg(
        F.sum("n").alias("initial_rows"),
        F.sum("neg").alias("negatives"),
        F.sum("zero").alias("zeros"),
        F.sum("null").alias("missing"),
        F.sum(F.when(kept > 0, kept - 1).otherwise(0)).alias("duplicates"),
        F.count_if(kept > 0).alias("final_rows"),
    )
    return totals.withColumn(
        "removed_pct", F.try_divide(F.col("initial_rows") - F.col("final_rows"), F.col("initial_rows")) * 100.0
    )


def in_date_range(df: DataFrame, start: str, end: str, end_inclusive_day: bool = False) -> DataFrame:
    """Both ends inclusive; a bare end date means its midnight unless ``end_inclusive_day``."""
    ts = F.col("timestamp")
    low, high = (F.lit(s).cast("timestamp_ntz") for s in (start, end))
    if end_inclusive_day:
        return df.filter((ts >= low) & (ts < high + F.expr("interval 1 day")))
    return df.filter(ts.between(low, high))


def of_meter_type(df: DataFrame, meter_type: str) -> DataFrame:
    """Filter by meter name; "all", an unknown name or a table without meters means no filter."""
    if meter_type not in METER_CODES or "meter" not in df.columns:
        return df
    return df.filter(F.col("meter") == F.lit(METER_CODES[meter_type]))


def missing_shares(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Percentage of rows without a reading, per building."""
    return df.groupBy("building_id").agg(share(F.col(value).isNull()).alias("missing_pct"))


def zero_shares(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Percentage of zero readings per building; missing ones count in the denominator."""
    return df.groupBy("building_id").agg(share(F.col(value) == 0).alias("zero_pct"))


def exclude_buildings(df: DataFrame, excluded: DataFrame, salts: int = 64, broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of all other buildings.

    The list is stored once and its size checked: up to ``broadcast_rows`` ids are broadcast, and the readings are not
    shuffled. Beyond, the rows of a building are spread over ``salts`` tasks, with as many copies of each excluded id.
    """
    excluded = cut_lineage(excluded.select("building_id").distinct())
    if fits(excluded, broadcast_rows):
        return df.join(F.broadcast(excluded), "building_id", "left_anti").select(*df.columns)
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != "building_id"]), F.lit(salts))
    copies = excluded.select("building_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    kept = df.withColumn("__salt", spread.cast("int")).join(copies, ["building_id", "__salt"], "left_anti")
    return kept.select(*df.columns)


def drop_high_missing(df: DataFrame, threshold: float = 0.90, value: str = VALUE) -> DataFrame:
    return exclude_buildings(df, missing_shares(df, value).filter(F.col("missing_pct") > threshold * 100))


def drop_high_zero(df: DataFrame, threshold: float = 0.95, value: str = VALUE) -> DataFrame:
    return exclude_buildings(df, zero_shares(df, value).filter(F.col("zero_pct") > threshold * 100))


def drop_sparse(df: DataFrame, min_non_null: float = 0.70, value: str = VALUE) -> DataFrame:
    """Keep buildings with at least this share of present readings."""
    return exclude_buildings(df, missing_shares(df, value).filter(F.col("missing_pct") > (1 - min_non_null) * 100))


def outlier_bounds(
    df: DataFrame, method: str = "iqr", multiplier: float = 3.0, value: str = VALUE, **options
) -> DataFrame:
    """One row with lower_bound and upper_bound over all readings."""
    if method == "iqr":
        q = grouped_stats(df, [], [], value, {"q1": 0.25, "q3": 0.75}, **options)
        spread = (F.col("q3") - F.col("q1")) * multiplier
        return q.select((F.col("q1") - spread).alias("lower_bound"), (F.col("q3") + spread).alias("upper_bound"))
    m = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return m.select(
        (F.col("m") - F.col("s") * multiplier).alias("lower_bound"),
        (F.col("m") + F.col("s") * multiplier).alias("upper_bound"),
    )


def handle_outliers(
    df: DataFrame,
    method: str = "iqr",
    multiplier: float = 3.0,
    action: str = "clip",
    value: str = VALUE,
    **options,
) -> DataFrame:
    """Clip to the bounds, remove rows outside (and missing ones), or add an is_outlier flag."""
    bounds = outlier_bounds(df, method, multiplier, value, **options)
    both = bounds.select(F.struct("lower_bound", "upper_bound")).scalar()
    low, high = both["lower_bound"], both["upper_bound"]
    v = F.col(value)
    if action == "clip":
        return df.withColumn(value, clip(v, low, high))
    if action == "remove":
        return df.filter((v >= low) & (v <= high))
    if action == "flag":
        return df.withColumn("is_outlier", F.coalesce((v < low) | (v > high), F.lit(False)))
    raise ValueError(f"unknown outlier action {action!r}")


def clean_weather(
    df: DataFrame, max_gap: int = 2, method: str = "both", limit: int = HOT_ROWS, split: bool | None = None
) -> DataFrame:
    """Fill short gaps of every numeric weather column per site."""
    return fill_gaps(df, numeric_columns(df, ["site_id"]), ["site_id"], max_gap, method, limit=limit, split=split)


def clean_metadata(df: DataFrame, reference_year: int, strict: bool = True) -> DataFrame:
    """Building age, log area and a tidy primary use."""
    if has_columns(df, ["year_built"], strict):
        df = df.withColumn("building_age", building_age(F.col("year_built"), reference_year))
    if has_columns(df, ["square_feet"], strict):
        df = df.withColumn("log_square_feet", log_area(F.col("square_feet")))
    if has_columns(df, ["primary_use"], strict):
        df = df.withColumn("primary_use", tidy_category(F.col("primary_use")))
    return df


def clean_long(
    df: DataFrame,
    max_missing: float = 0.90,
    negative_action: str = "remove",
    drop_nulls: bool = False,
    max_gap: int = 2,
    outlier_method: str = "iqr",
    multiplier: float = 3.0,
    outlier_action: str = "clip",
    remove_high_zeros: bool = True,
    max_zero: float = 0.95,
    check_missing: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """The exploratory cleaner: sparse buildings, negatives, gaps, outliers, buildings of zeros.

    The filled readings are checkpointed: the bounds, the clipping and the shares of zeros each need a pass over them.
    """
    split = needs_split(df, ["building_id"], split=split)
    if check_missing:
        df = drop_high_missing(df, max_missing)
    df = handle_negatives(df, negative_action, drop_nulls)
    df = cut_lineage(fill_gaps(df, [VALUE], ["building_id"], max_gap, "both", split=split))
    df = handle_outliers(df, outlier_method, multiplier, outlier_action)
    return drop_high_zero(df, max_zero) if remove_high_zeros else df
