"""The joins of readings with metadata and weather, and between meter types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import lookup_join


def _suffix_clashes(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    clashes = [c for c in right.columns if c in left.columns and c not in keys]
    return right.withColumnsRenamed({c: c + suffix for c in clashes})


def attach_metadata(readings: DataFrame, metadata: DataFrame, **options) -> DataFrame:
    """Readings with their building's metadata; one row per building on the right."""
    right = _suffix_clashes(readings, metadata, ["building_id"], "_metadata")
    return lookup_join(readings, right, ["building_id"], **options)


def attach_weather(df: DataFrame, weather: DataFrame, **options) -> DataFrame:
    """Rows with the weather of their site and hour. A site and hour is a small group, so only NULL sites are spread."""
    right = _suffix_clashes(df, weather, ["site_id", "timestamp"], "_weather")
    return lookup_join(df, right, ["site_id", "timestamp"], salt_hot=False, **options)


def merge_all(readings: DataFrame, metadata: DataFrame, weather: DataFrame) -> DataFrame:
    return attach_weather(attach_metadata(readings, metadata), weather)


def meter_pairs(df: DataFrame, meters: Sequence[str] | None = None, max_types: int = 64) -> DataFrame:
    """Readings of two meter types of one building at one time, types in ascending order.

    The first row per (building, time, type) by ``ord`` and reading, NULL first, is used, so a repeated reading does not multiply the pairs. One shuffle by
    (building, time), after each task has reduced its rows to one reading a type; the pairs come from these, without a
    self join. Types are few and become columns: without ``meters`` they are listed first, and more than ``max_types``
    are an error. Rows with a NULL building, time or type, or of other types, make no pair; a NULL reading does.
    """
    order = ["ord", "meter_reading"] if "ord" in df.columns else ["meter_reading"]
    rows = df.filter("building_id is not null and timestamp is not null and meter is not null")
    if meters is None:
        meters = [r[0] for r in rows.select("meter").distinct().limit(max_types + 1).collect()]
    types = sorted(set(meters)) or [None]
    if len(types) > max_types:
        raise ValueError(f"more than {max_types} meter types")
    kind = rows.schema["meter"].dataType

    def first(kept) -> Column:
        reading = F.struct(F.lit(kept).cast(kind).alias("meter"), F.col("meter_reading").alias("reading"))
        return F.min_by(reading, F.when(F.col("meter") == F.lit(kept).cast(kind), F.struct(*order)))

    per_hour = rows.groupBy("building_id", "timestamp").agg(F.array(*[first(m) for m in types]).alias("__readings"))
    present = per_hour.withColumn("__readings", F.expr("filter(__readings, x -> x is not null)")).filter("size(__readings) > 1")
    pairs = F.expr(
        """flatten(transform(__readings, (x, i) -> transform(slice(__readings, i + 2, size(__readings)), y ->
          struct(x.meter as meter_1, x.reading as reading_1, y.meter as meter_2, y.reading as reading_2))))"""
    )
    return present.select("building_id", "timestamp", F.inline(pairs))
