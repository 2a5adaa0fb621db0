"""Timestamps, wide-to-long reshaping and reading-column resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

READING_NAMES = ("meter_reading", "reading", "value")


def parse_timestamps(df: DataFrame, column: str = "timestamp", errors: str = "raise") -> DataFrame:
    """Text to zone-free timestamps. Bad text fails the job ("raise") or becomes NULL ("null")."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.StringType) and errors == "null":
        return df.withColumn(column, F.expr(f"try_cast(`{column}` as timestamp_ntz)"))
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def bad_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """One row: how many non-null texts are no timestamp."""
    parsed = F.expr(f"try_cast(`{column}` as timestamp_ntz)")
    return df.agg(F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("bad_timestamps"))


def is_wide(df: DataFrame) -> bool:
    """The layout with one column per building: many columns, none of them a reading."""
    return "meter_reading" not in df.columns and len(df.columns) > 10


def _parses(df: DataFrame, column: str, sample: int) -> bool:
    """Whether the first few values of a column are all timestamps, and not numbers that read as years."""
    head = df.select(F.col(column).cast("string").alias("t")).filter("t is not null").limit(sample)
    times = F.expr("if(try_cast(t as double) is null, try_cast(t as timestamp_ntz), null)")
    seen = head.agg(F.count("*").alias("n"), F.count(times).alias("ok")).first()
    return seen["n"] > 0 and seen["n"] == seen["ok"]


def timestamp_column(df: DataFrame, sample: int = 100) -> str:
    """Name of a wide table's time column: "timestamp", or else the first column if it holds timestamps."""
    if "timestamp" in df.columns:
        return "timestamp"
    first = df.columns[0]
    if isinstance(df.schema[first].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return first
    if isinstance(df.schema[first].dataType, T.StringType) and _parses(df, first, sample):
        return first
    raise ValueError("no timestamp column in the wide table")


def to_long(
    df: DataFrame,
    time_col: str = "timestamp",
    building_cols: Sequence[str] | None = None,
    value_name: str = "meter_reading",
) -> DataFrame:
    """Wide to long, keeping NULL readings: one row per timestamp and building column."""
    names = [c for c in df.columns if c != time_col] if building_cols is None else list(building_cols)
    if not names:
        raise ValueError("no building columns")
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    labels = F.array(*[F.lit(c) for c in names])
    exploded = df.select(F.col(time_col).alias("timestamp"), F.posexplode(cells).alias("__i", value_name))
    return exploded.select("timestamp", F.get(labels, F.col("__i")).alias("building_id"), value_name)


def first_buildings(names: Sequence[str], n: int = 100) -> list[str]:
    """The first n building columns of a wide table, by position."""
    return list(names)[:n]


def resolve_reading(df: DataFrame) -> DataFrame:
    """Rename whichever reading column is present to meter_reading."""
    for name in READING_NAMES:
        if name in df.columns:
            return df.withColumnRenamed(name, "meter_reading")
    raise ValueError(f"no reading column; expected one of {READING_NAMES}")


def normalise_readings(df: DataFrame) -> DataFrame:
    """Any accepted meter layout to the long one with parsed timestamps and a double reading."""
    if is_wide(df):
        time_col = timestamp_column(df)
        df = to_long(parse_timestamps(df, time_col), time_col)
    df = resolve_reading(parse_timestamps(df))
    reading: Column = F.col("meter_reading").cast("double")
    return df.withColumns(
        {"building_id": F.col("building_id").cast("string"), "meter_reading": F.when(~F.isnan(reading), reading)}
    )
