"""Weather, building and interaction features, and feature selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least
from ..functions.physical import apparent_temperature, area_per_floor, relative_humidity, to_fahrenheit
from ..schemas import has_columns, numeric_columns
from .windows import add_weather_rolling

OTHER = "other"
NOT_FEATURES = (
    "timestamp",
    "meter_reading",
    "site_id",
    "building_id",
    "meter",
    "primary_use",
    "primary_use_grouped",
    "timestamp_weather",
)


def add_weather_features(weather: DataFrame, strict: bool = True, **options) -> DataFrame:
    """Humidity and moving temperature averages, on the weather table. ``options`` go to the moving averages."""
    if has_columns(weather, ["air_temperature", "dew_temperature"], strict):
        humidity = relative_humidity(F.col("air_temperature"), F.col("dew_temperature"))
        weather = weather.withColumn("relative_humidity", humidity)
    return add_weather_rolling(weather, **options) if has_columns(weather, ["air_temperature"], strict) else weather


def add_comfort(weather: DataFrame) -> DataFrame:
    """Apparent temperature from temperature, humidity and wind."""
    feels = apparent_temperature(F.col("air_temperature"), F.col("relative_humidity"), F.col("wind_speed"))
    return weather.withColumn("apparent_temperature", feels)


def degree_days(weather: DataFrame, base_fahrenheit: float = 65.0) -> DataFrame:
    """Heating and cooling degree days per site and day, from the daily mean temperature."""
    daily = weather.groupBy("site_id", F.to_date("timestamp").alias("date")).agg(
        to_fahrenheit(F.avg("air_temperature")).alias("mean_temperature_f")
    )
    mean, base = F.col("mean_temperature_f"), F.lit(base_fahrenheit)
    return daily.withColumns(
        {
            "heating_degree_days": at_least(base - mean, F.lit(0.0)),
            "cooling_degree_days": at_least(mean - base, F.lit(0.0)),
        }
    )


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values with their counts; ties go to the smaller value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(n)


def group_categories(df: DataFrame, top: DataFrame, column: str = "primary_use") -> DataFrame:
    """Values outside the (at most n-row) top table, and NULL, become "other"."""
    kept = F.broadcast(top.select(F.col(column), F.col(column).alias("__kept")))
    grouped = df.join(kept, column, "left").withColumn(f"{column}_grouped", F.coalesce("__kept", F.lit(OTHER)))
    return grouped.select(*df.columns, f"{column}_grouped")


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str = "use") -> DataFrame:
    """A 0/1 column per listed value."""
    return df.withColumns({f"{prefix}_{v}": (F.col(column) == v).cast("int") for v in values})


def add_building_features(
    df: DataFrame, top: DataFrame, values: Sequence[str] | None = None, strict: bool = True
) -> DataFrame:
    """Grouped use with its dummy columns, and area per floor.

    Column names depend on the data, so the at most eleven values are read on the driver unless given.
    """
    if has_columns(df, ["primary_use"], strict):
        df = group_categories(df, top)
        if values is None:
            values = sorted({row[0] for row in top.select("primary_use").collect()} | {OTHER})
        df = one_hot(df, "primary_use_grouped", values)
    if has_columns(df, ["square_feet", "floor_count"], strict):
        df = df.withColumn("sqft_per_floor", area_per_floor(F.col("square_feet"), F.col("floor_count")))
    return df


def category_means(train: DataFrame, column: str = "primary_use", target: str = "meter_reading") -> DataFrame:
    """Mean target per category over training rows only."""
    return train.groupBy(column).agg(F.avg(target).alias(f"{column}_target_mean"))


def add_interactions(
    df: DataFrame, pairs: Sequence[tuple[str, str]] = (("air_temperature", "hour"), ("is_weekend", "hour"))
) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def warm_up_columns(columns: Sequence[str], target: str = "meter_reading") -> list[str]:
    """Outputs of the lag, rolling and weather-average operators, by their exact name patterns."""
    starts = (f"{target}_lag_", f"{target}_rolling_", "air_temperature_rolling_")
    return [c for c in columns if c.startswith(starts)]


def drop_warm_up(df: DataFrame, target: str = "meter_reading") -> DataFrame:
    """Drop rows without a reading or without history."""
    return df.na.drop("any", subset=[target, *warm_up_columns(df.columns, target)])


def feature_columns(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    """All numeric columns that are neither keys nor target."""
    return numeric_columns(df, exclude)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select, each column once."""
    return df.select(*dict.fromkeys(columns))


def where_equal(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Equality filter on one or more columns."""
    for name, wanted in values.items():
        df = df.filter(F.col(name) == F.lit(wanted))
    return df
