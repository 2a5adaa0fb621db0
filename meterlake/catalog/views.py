"""Meter tables derived from the shared star-schema tables, the same on Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_metadata, clean_weather, drop_duplicates, keep_non_negative
from ..operators.windows import hourly_grid

REFERENCE_YEAR = 2025
TIE = 1e-10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    site = F.concat(F.lit("S"), "c_nationkey")
    full = F.concat(site, F.lit("_"), F.lower("c_mktsegment"), F.lit("_B"), "c_custkey")
    short = F.concat(F.lit("B"), "c_custkey")
    return c.select(
        "c_custkey",
        "c_acctbal",
        "c_mktsegment",
        site.alias("site_id"),
        F.when(F.col("c_custkey") % 29 == 0, short).otherwise(full).alias("building_id"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings with negatives, zeros, missing values and repeated hours."""
    e = table(spark, sf, "events")
    i = ids(spark, sf).select("c_custkey", "building_id")
    value = (
        F.when(F.col("event_id") % 17 == 0, None)
        .when(F.col("event_id") % 13 == 0, F.lit(0.0))
        .otherwise(F.round(F.col("value") - 5.0, 6))
    )
    return e.join(i, e.user_id == i.c_custkey).select(
        "building_id",
        hour_of("ts").alias("timestamp"),
        F.col("event_type").alias("meter"),
        value.alias("meter_reading"),
        F.col("event_id").alias("ord"),
    )


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned readings: no negatives, one row per building and hour."""
    return drop_duplicates(keep_non_negative(readings(spark, sf)), ["building_id", "timestamp"])


def kept_meters(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned readings with one row per building, hour and meter."""
    return drop_duplicates(keep_non_negative(readings(spark, sf)))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned readings on a gap-free hourly grid per building."""
    return hourly_grid(kept(spark, sf).select("building_id", "timestamp", "meter_reading"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    floors = F.when(key % 7 == 0, None).when(key % 11 == 0, F.lit(0.0)).otherwise((key % 10 + 1).cast("double"))
    return ids(spark, sf).select(
        "building_id",
        "site_id",
        F.concat(F.lit("  "), "c_mktsegment", F.lit("-"), key % 4, F.lit(" ")).alias("primary_use"),
        (F.col("c_acctbal") + 1000.0).alias("square_feet"),
        (F.lit(1900) + key % 125).cast("int").alias("year_built"),
        floors.alias("floor_count"),
    )


def weather_obs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = ids(spark, sf).select("c_custkey", "site_id")
    return (
        e.join(i, e.user_id == i.c_custkey)
        .groupBy("site_id", hour_of("ts").alias("timestamp"))
        .agg(
            F.round(F.avg("value") / 10.0 + TIE, 6).alias("air_temperature"),
            F.round(F.min("value") / 12.0 + TIE, 6).alias("dew_temperature"),
            F.round(F.max("value") / 50.0 + TIE, 6).alias("wind_speed"),
            (F.lit(1000.0) + F.count(F.lit(1))).alias("sea_level_pressure"),
        )
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly weather per site; hours without an observation are NULL."""
    return hourly_grid(weather_obs(spark, sf), ["site_id"])


def weather_filled(spark: SparkSession, sf: str) -> DataFrame:
    return clean_weather(weather(spark, sf))


def metadata_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_metadata(metadata(spark, sf), REFERENCE_YEAR)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("client"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("slice"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 1500.0).alias("prediction"),
    )


def sites(spark: SparkSession, sf: str) -> list[str]:
    """The site names, one per nation; the nation table has a fixed 25 rows."""
    return [f"S{r[0]}" for r in table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table: one column of summed readings per site."""
    i = metadata(spark, sf).select("building_id", "site_id")
    joined = kept(spark, sf).join(i, "building_id")
    totals = joined.groupBy("timestamp").pivot("site_id", sites(spark, sf)).agg(F.sum("meter_reading"))
    return totals


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; the tiny offset keeps exact ties from depending on the last bit."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c) + TIE, digits) for c in doubles}) if doubles else df


# The same tables in SQL.
CTE = """WITH ids AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, 'S' || c_nationkey AS site_id,
    CASE WHEN c_custkey % 29 = 0 THEN 'B' || c_custkey
      ELSE 'S' || c_nationkey || '_' || lower(c_mktsegment) || '_B' || c_custkey END AS building_id
  FROM customer),
readings AS (
  SELECT i.building_id, date_trunc('hour', e.ts) AS timestamp, e.event_type AS meter,
    CASE WHEN e.event_id % 17 = 0 THEN NULL WHEN e.event_id % 13 = 0 THEN cast(0 AS double)
      ELSE round(e.value - cast(5 AS double), 6) END AS meter_reading, e.event_id AS ord
  FROM events e JOIN ids i ON i.c_custkey = e.user_id),
kept AS (
  SELECT * FROM readings WHERE meter_reading IS NULL OR meter_reading >= 0
  QUALIFY row_number() OVER (PARTITION BY building_id, timestamp ORDER BY ord) = 1),
kept_meters AS (
  SELECT * FROM readings WHERE meter_reading IS NULL OR meter_reading >= 0
  QUALIFY row_number() OVER (PARTITION BY building_id, timestamp, meter ORDER BY ord) = 1),
grid AS (
  SELECT g.building_id, g.timestamp, k.meter_reading
  FROM (SELECT building_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp
        FROM (SELECT building_id, min(timestamp) AS lo, max(timestamp) AS hi FROM kept GROUP BY 1) b) g
  LEFT JOIN kept k ON k.building_id = g.building_id AND k.timestamp = g.timestamp),
metadata AS (
  SELECT building_id, site_id, '  ' || c_mktsegment || '-' || (c_custkey % 4) || ' ' AS primary_use,
    c_acctbal + cast(1000 AS double) AS square_feet, cast(1900 + c_custkey % 125 AS int) AS year_built,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN cast(0 AS double)
      ELSE cast(c_custkey % 10 + 1 AS double) END AS floor_count
  FROM ids),
metadata_clean AS (
  SELECT building_id, site_id, lower(trim(primary_use)) AS primary_use, square_feet, year_built, floor_count,
    greatest(2025 - year_built, 0)::int AS building_age, ln(1 + square_feet) AS log_square_feet
  FROM metadata),
weather_obs AS (
  SELECT i.site_id, date_trunc('hour', e.ts) AS timestamp,
    round(avg(e.value) / cast(10 AS double) + 1e-10, 6) AS air_temperature,
    round(min(e.value) / cast(12 AS double) + 1e-10, 6) AS dew_temperature,
    round(max(e.value) / cast(50 AS double) + 1e-10, 6) AS wind_speed,
    cast(1000 AS double) + count(*) AS sea_level_pressure
  FROM events e JOIN ids i ON i.c_custkey = e.user_id GROUP BY 1, 2),
weather AS (
  SELECT g.site_id, g.timestamp, o.air_temperature, o.dew_temperature, o.wind_speed, o.sea_level_pressure
  FROM (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp
        FROM (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM weather_obs GROUP BY 1) b) g
  LEFT JOIN weather_obs o ON o.site_id = g.site_id AND o.timestamp = g.timestamp),
weather_forward AS (
  SELECT site_id, timestamp,
    last_value(air_temperature IGNORE NULLS) OVER w AS air_temperature,
    last_value(dew_temperature IGNORE NULLS) OVER w AS dew_temperature,
    last_value(wind_speed IGNORE NULLS) OVER w AS wind_speed,
    last_value(sea_level_pressure IGNORE NULLS) OVER w AS sea_level_pressure
  FROM weather WINDOW w AS (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
weather_filled AS (
  SELECT site_id, timestamp,
    first_value(air_temperature IGNORE NULLS) OVER w AS air_temperature,
    first_value(dew_temperature IGNORE NULLS) OVER w AS dew_temperature,
    first_value(wind_speed IGNORE NULLS) OVER w AS wind_speed,
    first_value(sea_level_pressure IGNORE NULLS) OVER w AS sea_level_pressure
  FROM weather_forward WINDOW w AS (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
scored AS (
  SELECT l_suppkey AS client, l_shipdate AS timestamp, l_returnflag AS slice, l_extendedprice AS actual,
    l_quantity * cast(1500 AS double) AS prediction FROM lineitem),
wide_long AS (
  SELECT t.timestamp, s.site_id AS building_id, v.meter_reading
  FROM (SELECT DISTINCT timestamp FROM kept) t CROSS JOIN (SELECT 'S' || n_nationkey AS site_id FROM nation) s
  LEFT JOIN (SELECT k.timestamp, m.site_id, sum(k.meter_reading) AS meter_reading
             FROM kept k JOIN metadata m ON m.building_id = k.building_id GROUP BY 1, 2) v
    ON v.timestamp = t.timestamp AND v.site_id = s.site_id)
"""


def sql(body: str) -> str:
    """A query over the derived tables."""
    return CTE + body


def r(expression: str, digits: int = 6) -> str:
    """SQL counterpart of ``rounded`` for one expression."""
    return f"round({expression} + 1e-10, {digits})"
