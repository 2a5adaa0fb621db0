"""Raw tables to one cleaned, joined frame, and from there to model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.calendar import add_calendar_features
from ..operators.cleaning import (
    clean_metadata,
    clean_readings,
    clean_weather,
    in_date_range,
    of_meter_type,
)
from ..operators.features import add_building_features, add_weather_features, drop_warm_up, top_categories
from ..operators.joins import merge_all
from ..operators.reshape import normalise_readings
from ..operators.skew import needs_split
from ..operators.windows import add_temporal_features
from ..sources.files import read_parquet, write_parquet, write_readings
from ..sources.meters import read_raw

STEP_LAGS = (1, 24)
STEP_ROLLING = ((24, ("mean",)),)


def prepare(
    readings: DataFrame,
    metadata: DataFrame,
    weather: DataFrame,
    reference_year: int,
    start: str = "2016-01-01",
    end: str = "2017-12-31",
    meter_type: str = "electricity",
    end_inclusive_day: bool = False,
    weather_fill: str = "both",
    strict: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """Clean the three tables, derive the weather features, join, and keep the period and meter type.

    The filters only touch key columns of the readings, so they are applied before the duplicate removal and the joins.
    Without hot buildings the readings are shuffled once, by building, for this and all later windows over buildings.
    """
    # The ordinal comes after the filters, which reach the scan then; it keeps the order of the remaining rows.
    wanted = of_meter_type(in_date_range(readings, start, end, end_inclusive_day), meter_type)
    co_locate = () if needs_split(wanted, ["building_id"], split=split) else ("building_id",)
    kept = clean_readings(wanted, co_locate=co_locate)
    split_sites = needs_split(weather, ["site_id"])
    filled = clean_weather(weather, method=weather_fill, split=split_sites)
    hourly_weather = add_weather_features(filled, strict, split=split_sites)
    return merge_all(kept, clean_metadata(metadata, reference_year, strict), hourly_weather)


def build_features(
    df: DataFrame,
    lags: Sequence[int] = STEP_LAGS,
    rolling=STEP_ROLLING,
    group_cols: Sequence[str] | None = None,
    top_uses: DataFrame | None = None,
    use_values: Sequence[str] | None = None,
    strict: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """Calendar, building and history columns; rows without history are dropped.

    History is that of a building's meter where the table has a meter column, unless ``group_cols`` says otherwise.
    ``top_uses`` (value, count) ranks the categories; by default it is counted over the rows of ``df``.
    """
    if group_cols is None:
        group_cols = [c for c in ("building_id", "meter") if c in df.columns]
    top = top_categories(df, "primary_use") if top_uses is None else top_uses
    out = add_temporal_features(df, lags=lags, rolling=rolling, group_cols=group_cols, split=split)
    out = add_building_features(add_calendar_features(out), top, use_values, strict)
    return drop_warm_up(out)


def run_cleaning(spark: SparkSession, data_dir: str, out_dir: str, reference_year: int, **options) -> DataFrame:
    """Files in, tables out: the three cleaned tables, and the joined one partitioned by site."""
    meters, metadata, weather = read_raw(spark, data_dir)
    readings = normalise_readings(meters)
    write_parquet(clean_readings(readings).drop("ord"), f"{out_dir}/meter_clean")
    write_parquet(clean_weather(weather), f"{out_dir}/weather_clean")
    write_parquet(clean_metadata(metadata, reference_year), f"{out_dir}/metadata_clean")
    write_readings(prepare(readings, metadata, weather, reference_year, **options).drop("ord"), f"{out_dir}/processed")
    return read_parquet(spark, f"{out_dir}/processed")


def run_features(spark: SparkSession, processed: str, out: str, **options) -> DataFrame:
    """The stage between cleaning and training; stages hand over parquet tables."""
    write_readings(build_features(read_parquet(spark, processed), **options), out)
    return read_parquet(spark, out)
