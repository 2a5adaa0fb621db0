"""Meter files: first available of several, one wide file, or one per meter type."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import first_buildings, parse_timestamps, timestamp_column, to_long
from .files import read_csv, read_metadata, read_text_table, read_weather, typed_cells

METER_FILES = ("train.csv", "electricity.csv", "meter_readings.csv")
METER_TYPES = ("electricity", "chilledwater", "hotwater", "steam")


def first_existing(spark: SparkSession, folder: str, names: Sequence[str]) -> str | None:
    """The first of the files that can be opened."""
    for name in names:
        path = f"{folder}/{name}"
        try:
            spark.read.text(path)
        except AnalysisException:
            continue
        return path
    return None


def read_meters(spark: SparkSession, folder: str, names: Sequence[str] = METER_FILES) -> DataFrame:
    path = first_existing(spark, folder, names)
    if path is None:
        raise FileNotFoundError(f"none of {list(names)} in {folder}")
    return read_csv(spark, path)


def read_raw(spark: SparkSession, folder: str, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meters, metadata, weather) of a data folder."""
    return (
        read_meters(spark, folder),
        read_metadata(spark, f"{folder}/metadata.csv", strict),
        read_weather(spark, f"{folder}/weather.csv"),
    )


def read_wide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readings, rejected cells) of a wide file whose columns beside the time are readings, so no type is inferred.

    Rejected are (time column, column, text) of cells that are no number; they are NULL in the readings. The time stays text.
    """
    text = read_text_table(spark, path)
    time_col = timestamp_column(text)
    kinds = {c: T.StringType() if c == time_col else T.DoubleType() for c in text.columns}
    return typed_cells(text, kinds, [time_col])


def read_wide_long(
    spark: SparkSession, path: str, buildings: int | None = None, drop_missing: bool = False
) -> DataFrame:
    """One wide file as long readings; optionally the first few buildings, and only present readings."""
    wide, _ = read_wide(spark, path)
    time_col = timestamp_column(wide)
    names = [c for c in wide.columns if c != time_col]
    chosen = names if buildings is None else first_buildings(names, buildings)
    long = to_long(parse_timestamps(wide, time_col), time_col, chosen)
    return long.na.drop("any") if drop_missing else long


def read_meter_types(
    spark: SparkSession, folder: str, meter_types: Sequence[str] = METER_TYPES, row_cap: int | None = None
) -> DataFrame:
    """Long readings of all meter types that have a readable file with a timestamp column.

    ``row_cap`` keeps each file's first timestamps in time order.
    """
    tables = []
    for meter in meter_types:
        path = first_existing(spark, folder, [f"{meter}.txt", f"{meter}.csv"])
        if path is None:
            continue
        columns = read_text_table(spark, path).columns
        if "timestamp" not in columns or len(columns) < 2:
            continue
        wide = parse_timestamps(read_wide(spark, path)[0])
        if row_cap is not None:
            wide = wide.orderBy("timestamp").limit(row_cap)
        tables.append(to_long(wide).withColumn("meter", F.lit(meter)))
    if not tables:
        raise FileNotFoundError(f"no meter files in {folder}")
    return reduce(DataFrame.unionByName, tables)
