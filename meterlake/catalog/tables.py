"""Sources, sinks, filters, reshaping, joins and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..functions.physical import parse_building_id
from ..operators import cleaning, features, joins, reshape, windows
from ..operators.splits import seeded_sample
from ..schemas import METADATA, WEATHER
from ..sources import files, meters, provenance
from ..session import scratch_path
from . import views
from .registry import register
from .views import r, rounded, sql

# --- scans and sinks -------------------------------------------------------------------------------------------------


@register("csv_metadata_scan", sql("SELECT building_id, site_id, trim(primary_use) AS primary_use, square_feet, year_built, floor_count FROM metadata"))
def csv_metadata_scan(spark, sf):
    path = scratch_path(spark, "metadata")
    files.write_csv(views.metadata(spark, sf).withColumn("primary_use", F.trim("primary_use")), path)
    return files.read_csv(spark, path, METADATA)


@register("csv_weather_scan", sql("SELECT * FROM weather"))
def csv_weather_scan(spark, sf):
    path = scratch_path(spark, "weather")
    files.write_csv(views.weather(spark, sf), path)
    return files.read_csv(spark, path, WEATHER, strict=False)


def _spoilt(spark, sf):
    """Events as a text table in which some values are no numbers and some user ids have a letter."""
    path = scratch_path(spark, "spoilt")
    e, n = views.table(spark, sf, "events"), F.col("event_id")
    value = F.when(n % 23 == 0, F.concat(F.lit("n/a "), n)).when(n % 19 != 0, (n / 8).cast("string"))
    user = F.when(n % 31 == 0, F.concat(F.lit("u"), "user_id")).otherwise(F.col("user_id").cast("string"))
    files.write_csv(e.select("event_id", user.alias("user_id"), value.alias("value")), path)
    kinds = {"event_id": T.LongType(), "user_id": T.LongType(), "value": T.DoubleType()}
    return files.typed_cells(files.read_text_table(spark, path), kinds, ["event_id"])


@register("typed_cells", """SELECT event_id::bigint AS event_id, CASE WHEN event_id % 31 <> 0 THEN user_id END::bigint AS user_id,
  CASE WHEN event_id % 23 <> 0 AND event_id % 19 <> 0 THEN event_id / 8 END AS value FROM events""")
def typed_cells(spark, sf):
    return _spoilt(spark, sf)[0]


@register("rejected_cells", """SELECT event_id::varchar AS row_id, 'value' AS "column", 'n/a ' || event_id AS text FROM events
  WHERE event_id % 23 = 0 UNION ALL SELECT event_id::varchar, 'user_id', 'u' || user_id FROM events WHERE event_id % 31 = 0""")
def rejected_cells(spark, sf):
    return _spoilt(spark, sf)[1].withColumnRenamed("event_id", "row_id")


@register("first_meter_file", sql("SELECT building_id, timestamp, meter, meter_reading, ord FROM readings"))
def first_meter_file(spark, sf):
    folder = scratch_path(spark, "raw")
    files.write_csv(views.readings(spark, sf), f"{folder}/electricity.csv")
    found = reshape.normalise_readings(meters.read_meters(spark, folder))
    return found.withColumn("ord", F.col("ord").cast("bigint"))


@register(
    "meter_type_files",
    sql("""SELECT d.timestamp, s.building_id, v.meter_reading, d.meter
  FROM (SELECT DISTINCT meter, timestamp FROM kept_meters WHERE meter IS NOT NULL) d
  CROSS JOIN (SELECT 'S' || n_nationkey AS building_id FROM nation) s
  LEFT JOIN (SELECT k.meter, k.timestamp, m.site_id, """ + r("sum(k.meter_reading)") + """ AS meter_reading
             FROM kept_meters k JOIN metadata m ON m.building_id = k.building_id GROUP BY 1, 2, 3) v
  ON v.meter = d.meter AND v.timestamp = d.timestamp AND v.site_id = s.building_id"""),
)
def meter_type_files(spark, sf):
    """One wide file per meter type, read together; a type without a file is skipped."""
    folder = scratch_path(spark, "types")
    sites = views.sites(spark, sf)
    joined = views.kept_meters(spark, sf).join(views.metadata(spark, sf).select("building_id", "site_id"), "building_id")
    types = sorted(r["meter"] for r in joined.select("meter").distinct().collect() if r["meter"] is not None)
    for i, meter in enumerate(types):
        suffix = ("txt", "csv")[i % 2]
        rows = joined.filter(F.col("meter") == meter)
        wide = rows.groupBy("timestamp").pivot("site_id", sites).agg(F.sum("meter_reading"))
        files.write_csv(wide, f"{folder}/{meter}.{suffix}")
    return rounded(meters.read_meter_types(spark, folder, [*types, "absent"]))


@register("wide_file_long", sql("SELECT timestamp, building_id, " + r("meter_reading") + " AS meter_reading FROM wide_long WHERE meter_reading IS NOT NULL"))
def wide_file_long(spark, sf):
    path = scratch_path(spark, "wide")
    files.write_csv(views.wide(spark, sf), path)
    return rounded(meters.read_wide_long(spark, path, drop_missing=True))


@register("parquet_round_trip", sql("SELECT * FROM kept"))
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "kept")
    files.write_parquet(views.kept(spark, sf), path)
    return files.read_parquet(spark, path)


@register(
    "readings_stored_by_site",
    sql("SELECT m.site_id, count(*) AS n, count(DISTINCT k.building_id) AS buildings, " + r("sum(k.meter_reading)", 4)
        + " AS total FROM kept k LEFT JOIN metadata m ON m.building_id = k.building_id GROUP BY 1"),
)
def readings_stored_by_site(spark, sf):
    """Joined readings written as a table partitioned by site, then aggregated per site."""
    path = scratch_path(spark, "by-site")
    joined = joins.attach_metadata(views.kept(spark, sf), views.metadata(spark, sf).select("building_id", "site_id"))
    files.write_readings(joined, path)
    stored = files.read_parquet(spark, path)
    per_building = stored.groupBy("site_id", "building_id").agg(F.count(F.lit(1)).alias("n"), F.sum("meter_reading").alias("t"))
    return rounded(
        per_building.groupBy("site_id").agg(
            F.sum("n").alias("n"), F.count("building_id").alias("buildings"), F.sum("t").alias("total")
        ),
        4,
    )


@register("json_round_trip", sql("SELECT building_id, count(meter_reading) AS n, " + r("avg(meter_reading)") + " AS mean FROM kept GROUP BY 1"))
def json_round_trip(spark, sf):
    path = scratch_path(spark, "report")
    stats = views.kept(spark, sf).groupBy("building_id").agg(F.count("meter_reading").alias("n"), F.avg("meter_reading").alias("mean"))
    files.write_report({"stats": stats}, path)
    return rounded(files.read_json(spark, f"{path}/stats", "building_id string, n bigint, mean double"))


@register("cleaned_sample_export", sql("SELECT * FROM (SELECT timestamp, building_id, meter_reading FROM kept ORDER BY timestamp, building_id LIMIT 500)"))
def cleaned_sample_export(spark, sf):
    path = scratch_path(spark, "sample")
    files.export_sample(views.kept(spark, sf).select("timestamp", "building_id", "meter_reading"), path, 500)
    return reshape.normalise_readings(files.read_csv(spark, path))


@register("scored_export", sql("SELECT client::varchar AS building_id, count(*) AS n, " + r("avg(actual)", 4) + " AS actual, " + r("avg(prediction)", 4) + " AS prediction FROM scored GROUP BY 1"))
def scored_export(spark, sf):
    """Scored rows of all buildings, one folder each, read back and averaged."""
    path = scratch_path(spark, "scored")
    rows = views.scored(spark, sf).withColumn("building_id", F.col("client").cast("string")).drop("client")
    files.export_scored(rows, path)
    schema = "timestamp timestamp_ntz, slice string, actual double, prediction double, building_id string"
    back = spark.read.option("header", True).schema(schema).csv(path)
    return rounded(
        back.groupBy("building_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("actual").alias("actual"), F.avg("prediction").alias("prediction")
        ),
        4,
    )


@register("file_provenance")
def file_provenance(spark, sf):
    return provenance.provenance(spark, sf, "*.parquet").drop("modified")


@register(
    "absent_inputs",
    "SELECT unnest(['metadata.csv', 'weather.csv', 'train.csv|electricity.csv']) AS requirement",
)
def absent_inputs(spark, sf):
    """What the folder of shared tables lacks as a meter data folder: everything but the listed tables."""
    return provenance.missing_inputs(spark, sf)


# --- projections, filters, reshaping ---------------------------------------------------------------------------------


@register("parsed_timestamps", sql("SELECT building_id, timestamp, meter_reading FROM readings"))
def parsed_timestamps(spark, sf):
    text = views.readings(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string"))
    return reshape.parse_timestamps(text).select("building_id", "timestamp", "meter_reading")


@register("bad_timestamp_count", "SELECT count(*) FILTER (WHERE event_type <> 'view') AS bad_timestamps FROM events")
def bad_timestamp_count(spark, sf):
    e = views.table(spark, sf, "events")
    mixed = F.when(F.col("event_type") == "view", F.col("ts").cast("string")).otherwise(F.col("event_type"))
    return reshape.bad_timestamps(e.select(mixed.alias("timestamp")))


@register("wide_to_long", sql("SELECT timestamp, building_id, " + r("meter_reading") + " AS meter_reading FROM wide_long"))
def wide_to_long(spark, sf):
    return rounded(reshape.to_long(views.wide(spark, sf)))


@register("wide_layout_detected", sql("SELECT timestamp, building_id, " + r("meter_reading") + " AS meter_reading FROM wide_long"))
def wide_layout_detected(spark, sf):
    """A wide table whose first column is a time column under another name."""
    return rounded(reshape.normalise_readings(views.wide(spark, sf).withColumnRenamed("timestamp", "time")))


@register("reading_column_resolved", sql("SELECT building_id, timestamp, meter_reading FROM readings"))
def reading_column_resolved(spark, sf):
    renamed = views.readings(spark, sf).select("building_id", "timestamp", F.col("meter_reading").alias("value"))
    return reshape.resolve_reading(renamed)


@register("nan_readings_as_null", sql("SELECT building_id, timestamp, meter_reading FROM readings"))
def nan_readings_as_null(spark, sf):
    raw = views.readings(spark, sf).select("building_id", "timestamp", F.coalesce("meter_reading", F.lit(float("nan"))).alias("meter_reading"))
    return nan_to_null(raw)


@register("non_negative_readings", sql("SELECT * FROM readings WHERE meter_reading IS NULL OR meter_reading >= 0"))
def non_negative_readings(spark, sf):
    return cleaning.keep_non_negative(views.readings(spark, sf))


@register("non_zero_readings", sql("SELECT * FROM readings WHERE meter_reading IS NULL OR meter_reading <> 0"))
def non_zero_readings(spark, sf):
    return cleaning.drop_zeros(views.readings(spark, sf))


@register("negatives_removed_with_nulls", sql("SELECT * FROM readings WHERE meter_reading >= 0"))
def negatives_removed_with_nulls(spark, sf):
    return cleaning.handle_negatives(views.readings(spark, sf), "remove", drop_nulls=True)


@register("negatives_clipped", sql("SELECT building_id, timestamp, meter, ord, CASE WHEN meter_reading < 0 THEN 0 ELSE meter_reading END AS meter_reading FROM readings"))
def negatives_clipped(spark, sf):
    return cleaning.handle_negatives(views.readings(spark, sf), "clip")


@register("complete_rows", sql("SELECT * FROM metadata WHERE floor_count IS NOT NULL"))
def complete_rows(spark, sf):
    return cleaning.drop_any_null(views.metadata(spark, sf))


@register("readings_in_period", sql("SELECT * FROM readings WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"))
def readings_in_period(spark, sf):
    return cleaning.in_date_range(views.readings(spark, sf), "2024-01-05", "2024-01-20")


@register("readings_in_whole_days", sql("SELECT * FROM readings WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21'"))
def readings_in_whole_days(spark, sf):
    return cleaning.in_date_range(views.readings(spark, sf), "2024-01-05", "2024-01-20", end_inclusive_day=True)


# Numeric meter codes for the test tables' event types.
_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3}


@register(
    "readings_of_meter_type",
    sql("""SELECT building_id, timestamp, ord, meter_reading, CASE meter WHEN 'click' THEN 0 WHEN 'error' THEN 1
  WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS meter FROM readings WHERE meter = 'error'"""),
)
def readings_of_meter_type(spark, sf):
    code = F.coalesce(*[F.when(F.col("meter") == name, F.lit(c)) for name, c in _CODES.items()])
    return cleaning.of_meter_type(views.readings(spark, sf).withColumn("meter", code), "chilledwater")


@register("client_columns", sql("SELECT building_id, site_id, square_feet FROM metadata"))
def client_columns(spark, sf):
    return features.project(views.metadata(spark, sf), ["building_id", "site_id", "square_feet", "site_id"])


@register("numeric_feature_names", sql("SELECT building_id, " + r("square_feet") + " AS square_feet, year_built, floor_count, building_age, " + r("log_square_feet") + " AS log_square_feet FROM metadata_clean"))
def numeric_feature_names(spark, sf):
    """Feature selection by type, next to the building id."""
    m = views.metadata_clean(spark, sf)
    return rounded(m.select("building_id", *features.feature_columns(m)))


@register("site_filter", sql("SELECT * FROM metadata WHERE site_id = 'S7'"))
def site_filter(spark, sf):
    return features.where_equal(views.metadata(spark, sf), {"site_id": "S7"})


@register("first_buildings_sample", sql("SELECT timestamp, building_id, " + r("meter_reading") + " AS meter_reading FROM wide_long WHERE substr(building_id, 2)::int < 10"))
def first_buildings_sample(spark, sf):
    """The first 10 building columns by position."""
    wide = views.wide(spark, sf)
    return rounded(reshape.to_long(wide, "timestamp", reshape.first_buildings(wide.columns[1:], 10)))


@register("seeded_row_sample", sql("SELECT building_id, timestamp, meter_reading, ord FROM readings ORDER BY md5(concat_ws('|', ord::varchar, '42')), ord LIMIT 700"))
def seeded_row_sample(spark, sf):
    rows = views.readings(spark, sf).select("building_id", "timestamp", "meter_reading", "ord")
    return seeded_sample(rows, ["ord"], 700, 42)


@register(
    "high_missing_excluded",
    sql("""SELECT * FROM readings WHERE building_id IN (
  SELECT building_id FROM readings GROUP BY 1 HAVING count(*) FILTER (WHERE meter_reading IS NULL) / count(*) * 100.0 <= 10)"""),
)
def high_missing_excluded(spark, sf):
    return cleaning.drop_high_missing(views.readings(spark, sf), 0.10)


@register(
    "sparse_grid_excluded",
    sql("""SELECT * FROM grid WHERE building_id IN (
  SELECT building_id FROM grid GROUP BY 1 HAVING count(*) FILTER (WHERE meter_reading IS NULL) / count(*) * 100.0 <= 90)"""),
)
def sparse_grid_excluded(spark, sf):
    return cleaning.drop_high_missing(views.grid(spark, sf))


# --- joins -----------------------------------------------------------------------------------------------------------


@register("readings_with_metadata", sql("SELECT k.*, m.site_id, m.primary_use, m.square_feet, m.year_built, m.floor_count FROM kept k LEFT JOIN metadata m ON m.building_id = k.building_id"))
def readings_with_metadata(spark, sf):
    return joins.attach_metadata(views.kept(spark, sf), views.metadata(spark, sf))


@register(
    "readings_with_weather",
    sql("""SELECT k.*, m.site_id, m.primary_use, m.square_feet, m.year_built, m.floor_count,
  w.air_temperature, w.dew_temperature, w.wind_speed, w.sea_level_pressure
  FROM kept k LEFT JOIN metadata m ON m.building_id = k.building_id
  LEFT JOIN weather_filled w ON w.site_id = m.site_id AND w.timestamp = k.timestamp"""),
)
def readings_with_weather(spark, sf):
    return joins.merge_all(views.kept(spark, sf), views.metadata(spark, sf), views.weather_filled(spark, sf))


@register(
    "readings_with_weather_shuffled",
    sql("""SELECT k.building_id, k.timestamp, m.site_id, w.air_temperature FROM kept k
  LEFT JOIN metadata m ON m.building_id = k.building_id AND m.floor_count IS NOT NULL
  LEFT JOIN weather_filled w ON w.site_id = m.site_id AND w.timestamp = k.timestamp"""),
)
def readings_with_weather_shuffled(spark, sf):
    """The same joins by the path for tables too large to broadcast, with buildings of unknown site."""
    known = views.metadata(spark, sf).filter("floor_count is not null").select("building_id", "site_id")
    weather = views.weather_filled(spark, sf).select("site_id", "timestamp", "air_temperature")
    placed = joins.attach_metadata(views.kept(spark, sf), known, broadcast_rows=0, limit=50)
    return joins.attach_weather(placed, weather, broadcast_rows=0).select("building_id", "timestamp", "site_id", "air_temperature")


@register(
    "meter_pairs_per_hour",
    sql("""SELECT a.building_id, a.timestamp, a.meter AS meter_1, a.meter_reading AS reading_1, b.meter AS meter_2,
  b.meter_reading AS reading_2 FROM kept_meters a JOIN kept_meters b
  ON a.building_id = b.building_id AND a.timestamp = b.timestamp AND a.meter < b.meter"""),
)
def meter_pairs_per_hour(spark, sf):
    return joins.meter_pairs(cleaning.keep_non_negative(views.readings(spark, sf)))


# --- cleaning --------------------------------------------------------------------------------------------------------


@register("first_reading_per_hour", sql("SELECT * FROM kept_meters"))
def first_reading_per_hour(spark, sf):
    return cleaning.clean_readings(views.readings(spark, sf))


@register("zeros_removed_first_reading", sql("""SELECT * FROM readings WHERE meter_reading IS NULL OR meter_reading > 0
  QUALIFY row_number() OVER (PARTITION BY building_id, timestamp, meter ORDER BY ord) = 1"""))
def zeros_removed_first_reading(spark, sf):
    return cleaning.clean_readings(views.readings(spark, sf), remove_zeros=True)


@register("weather_gaps_filled", sql("SELECT * FROM weather_filled"))
def weather_gaps_filled(spark, sf):
    return cleaning.clean_weather(views.weather(spark, sf))


_FORWARD = """last_value(meter_reading IGNORE NULLS) OVER (PARTITION BY building_id ORDER BY timestamp
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
_BACKWARD = """first_value({0} IGNORE NULLS) OVER (PARTITION BY building_id ORDER BY timestamp
  ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"""


@register("reading_gaps_forward", sql(f"SELECT building_id, timestamp, {_FORWARD} AS meter_reading FROM grid"))
def reading_gaps_forward(spark, sf):
    return windows.fill_gaps(views.grid(spark, sf), ["meter_reading"], ["building_id"], 2, "forward")


@register("reading_gaps_backward", sql(f"SELECT building_id, timestamp, {_BACKWARD.format('meter_reading')} AS meter_reading FROM grid"))
def reading_gaps_backward(spark, sf):
    return windows.fill_gaps(views.grid(spark, sf), ["meter_reading"], ["building_id"], 2, "backward")


_BOTH = f"""SELECT building_id, timestamp, {_BACKWARD.format('f')} AS meter_reading
  FROM (SELECT building_id, timestamp, {_FORWARD} AS f FROM grid)"""


@register("reading_gaps_both", sql(_BOTH))
def reading_gaps_both(spark, sf):
    return windows.fill_gaps(views.grid(spark, sf), ["meter_reading"], ["building_id"], 2, "both")


@register("reading_gaps_both_split", sql(_BOTH))
def reading_gaps_both_split(spark, sf):
    """The same by the path for groups too large for one task (every building counts as one here)."""
    return windows.fill_gaps(views.grid(spark, sf), ["meter_reading"], ["building_id"], 2, "both", limit=100)


@register("hourly_grid", sql("SELECT * FROM grid"))
def hourly_grid(spark, sf):
    return views.grid(spark, sf)


_IQR = """b AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(meter_reading, 0.25) AS q1, quantile_cont(meter_reading, 0.75) AS q3 FROM kept))"""


def _with(cte: str, body: str) -> str:
    return views.CTE.rstrip() + ", " + cte + " " + body


@register("outlier_bounds_iqr", _with(_IQR, "SELECT " + r("lo") + " AS lower_bound, " + r("hi") + " AS upper_bound FROM b"))
def outlier_bounds_iqr(spark, sf):
    return rounded(cleaning.outlier_bounds(views.kept(spark, sf)))


@register("outlier_bounds_zscore", sql("SELECT " + r("avg(meter_reading) - 3 * stddev_samp(meter_reading)") + " AS lower_bound, " + r("avg(meter_reading) + 3 * stddev_samp(meter_reading)") + " AS upper_bound FROM kept"))
def outlier_bounds_zscore(spark, sf):
    return rounded(cleaning.outlier_bounds(views.kept(spark, sf), "zscore"))


@register("outliers_clipped", _with(_IQR, "SELECT building_id, timestamp, meter, ord, " + r("CASE WHEN meter_reading < lo THEN lo WHEN meter_reading > hi THEN hi ELSE meter_reading END") + " AS meter_reading FROM kept, b"))
def outliers_clipped(spark, sf):
    return rounded(cleaning.handle_outliers(views.kept(spark, sf)))


@register("outliers_removed", _with(_IQR, "SELECT kept.* FROM kept, b WHERE meter_reading BETWEEN lo AND hi"))
def outliers_removed(spark, sf):
    return cleaning.handle_outliers(views.kept(spark, sf), action="remove")


@register("outliers_flagged", _with(_IQR, "SELECT kept.*, coalesce(meter_reading < lo OR meter_reading > hi, false) AS is_outlier FROM kept, b"))
def outliers_flagged(spark, sf):
    return cleaning.handle_outliers(views.kept(spark, sf), action="flag")


@register("missing_share_per_building", sql("SELECT building_id, " + r("count(*) FILTER (WHERE meter_reading IS NULL) / count(*) * 100.0") + " AS missing_pct FROM readings GROUP BY 1"))
def missing_share_per_building(spark, sf):
    return rounded(cleaning.missing_shares(views.readings(spark, sf)))


@register("zero_share_per_building", sql("SELECT building_id, " + r("count(*) FILTER (WHERE meter_reading = 0) / count(*) * 100.0") + " AS zero_pct FROM readings GROUP BY 1"))
def zero_share_per_building(spark, sf):
    return rounded(cleaning.zero_shares(views.readings(spark, sf)))


@register(
    "high_zero_excluded",
    sql("""SELECT * FROM readings WHERE building_id IN (
  SELECT building_id FROM readings GROUP BY 1 HAVING count(*) FILTER (WHERE meter_reading = 0) / count(*) * 100.0 <= 10)"""),
)
def high_zero_excluded(spark, sf):
    return cleaning.drop_high_zero(views.readings(spark, sf), 0.10)


@register(
    "min_non_null_ratio",
    sql("""SELECT * FROM readings WHERE building_id IN (
  SELECT building_id FROM readings GROUP BY 1 HAVING count(*) FILTER (WHERE meter_reading IS NULL) / count(*) * 100.0 <= (1 - 0.95::double) * 100)"""),
)
def min_non_null_ratio(spark, sf):
    return cleaning.drop_sparse(views.readings(spark, sf), 0.95)


@register(
    "exploratory_cleaning",
    views.CTE.rstrip() + f""", dense AS (SELECT * FROM grid WHERE building_id IN (
  SELECT building_id FROM grid GROUP BY 1 HAVING count(*) FILTER (WHERE meter_reading IS NULL) / count(*) * 100.0 <= 90)),
filled AS (SELECT building_id, timestamp, {_BACKWARD.format('f')} AS meter_reading
  FROM (SELECT building_id, timestamp, {_FORWARD} AS f FROM dense)),
b AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(meter_reading, 0.25) AS q1, quantile_cont(meter_reading, 0.75) AS q3 FROM filled)),
clipped AS (SELECT building_id, timestamp, CASE WHEN meter_reading < lo THEN lo WHEN meter_reading > hi THEN hi
  ELSE meter_reading END AS meter_reading FROM filled, b)
SELECT building_id, timestamp, """ + r("meter_reading") + """ AS meter_reading FROM clipped WHERE building_id IN (
  SELECT building_id FROM clipped GROUP BY 1 HAVING count(*) FILTER (WHERE meter_reading = 0) / count(*) * 100.0 <= 95)""",
)
def exploratory_cleaning(spark, sf):
    """All steps of the exploratory cleaner on the hourly grid."""
    return rounded(cleaning.clean_long(views.grid(spark, sf)))


@register("metadata_cleaned", sql("SELECT building_id, site_id, primary_use, " + r("square_feet") + " AS square_feet, year_built, floor_count, building_age, " + r("log_square_feet") + " AS log_square_feet FROM metadata_clean"))
def metadata_cleaned(spark, sf):
    return rounded(views.metadata_clean(spark, sf))


@register(
    "building_ids_parsed",
    sql("""SELECT building_id, CASE WHEN n >= 3 THEN p[1] ELSE 'unknown' END AS site,
  CASE WHEN n >= 3 THEN p[2] ELSE 'unknown' END AS use_type,
  CASE WHEN n >= 3 THEN array_to_string(p[3:], '_') ELSE building_id END AS building_name
  FROM (SELECT building_id, string_split(building_id, '_') AS p, len(string_split(building_id, '_')) AS n FROM ids)"""),
)
def building_ids_parsed(spark, sf):
    return views.ids(spark, sf).select("building_id").withColumns(parse_building_id(F.col("building_id")))
