"""Canonical table layouts and column-presence rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

READINGS = T.StructType(
    [
        T.StructField("building_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("meter", T.StringType()),
        T.StructField("meter_reading", T.DoubleType()),
        T.StructField("ord", T.LongType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("building_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("primary_use", T.StringType()),
        T.StructField("square_feet", T.DoubleType()),
        T.StructField("year_built", T.IntegerType()),
        T.StructField("floor_count", T.DoubleType()),
    ]
)

WEATHER_MEASURES = (
    "air_temperature",
    "dew_temperature",
    "sea_level_pressure",
    "wind_speed",
    "wind_direction",
    "cloud_coverage",
    "precip_depth",
)

WEATHER = T.StructType(
    [T.StructField("site_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(name, T.DoubleType()) for name in WEATHER_MEASURES]
)

# Integer codes of the meter types in long files.
METER_CODES = {"electricity": 0, "chilledwater": 1, "steam": 2, "hotwater": 3}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class MissingColumns(ValueError):
    """A strict operator was given a table without the columns it needs."""


def has_columns(df: DataFrame, names: Iterable[str], strict: bool = True) -> bool:
    """True if all are present; otherwise raise (strict) or tell the caller to skip."""
    absent = [name for name in names if name not in df.columns]
    if absent and strict:
        raise MissingColumns(f"missing columns {absent}; have {df.columns}")
    return not absent


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric and boolean columns in table order."""
    skip = set(exclude)
    kinds = NUMERIC + (T.BooleanType,)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, kinds)]
