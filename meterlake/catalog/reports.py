"""Profiles, building and meter reports, and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import cleaning_counts, handle_outliers
from ..operators.joins import merge_all
from ..operators.quantiles import exact_quantiles, grouped_stats
from ..operators.splits import time_split
from ..operators.windows import gap_intervals
from ..reports import building, meter, quality, temporal
from ..sources.files import as_json
from . import views
from .registry import register
from .views import r, rounded, sql

_HOURLY = (
    "SELECT hour(timestamp)::int AS hour, " + r("avg(meter_reading)") + " AS mean, " + r("median(meter_reading)")
    + " AS median, " + r("stddev_samp(meter_reading)") + " AS std, " + r("min(meter_reading)") + " AS min, "
    + r("max(meter_reading)") + " AS max, count(meter_reading) AS count FROM kept GROUP BY 1"
)


@register(
    "hourly_profile",
    sql(f"""SELECT p.*, s.peak_hour, s.low_hour, hour = peak_hour AS is_peak, hour = low_hour AS is_low FROM ({_HOURLY}) p,
  (SELECT arg_max(h, (m, -h)) AS peak_hour, arg_min(h, (m, h)) AS low_hour FROM
    (SELECT hour(timestamp)::int AS h, avg(meter_reading) AS m FROM kept GROUP BY 1)) s"""),
)
def hourly_profile(spark, sf):
    """Load profile by hour of day with its peak and low hour."""
    kept = views.kept(spark, sf)
    summary = temporal.hourly_summary(kept).select("peak_hour", "low_hour")
    hour = F.col("hour")
    peaks = temporal.hourly_stats(kept).withColumns(
        {"peak_hour": summary.select("peak_hour").scalar(), "low_hour": summary.select("low_hour").scalar()}
    )
    return rounded(peaks.withColumns({"is_peak": hour == F.col("peak_hour"), "is_low": hour == F.col("low_hour")}))


@register("hourly_stats", sql(_HOURLY))
def hourly_stats(spark, sf):
    return rounded(temporal.hourly_stats(views.kept(spark, sf)))


@register("hourly_stats_split", sql(_HOURLY))
def hourly_stats_split(spark, sf):
    """The same by the path for groups too large for one task's exact percentile."""
    return rounded(temporal.hourly_stats(views.kept(spark, sf), limit=100))


@register(
    "hourly_summary",
    sql("SELECT arg_max(h, (m, -h)) AS peak_hour, arg_min(h, (m, h)) AS low_hour, " + r("max(m)") + " AS peak_consumption, "
        + r("min(m)") + " AS low_consumption, " + r("stddev_samp(m)") + """ AS hourly_variance FROM
  (SELECT hour(timestamp)::int AS h, avg(meter_reading) AS m FROM kept GROUP BY 1)"""),
)
def hourly_summary(spark, sf):
    return rounded(temporal.hourly_summary(views.kept(spark, sf)))


def _simple(part: str, expression: str) -> str:
    return sql(
        f"SELECT {expression} AS {part}, " + r("avg(meter_reading)") + " AS mean, " + r("median(meter_reading)")
        + " AS median, " + r("stddev_samp(meter_reading)") + " AS std FROM kept GROUP BY 1"
    )


@register("weekday_stats", _simple("day_of_week", "(isodow(timestamp) - 1)::int"))
def weekday_stats(spark, sf):
    return rounded(temporal.daily_stats(views.kept(spark, sf)))


@register("monthly_stats", _simple("month", "month(timestamp)::int"))
def monthly_stats(spark, sf):
    return rounded(temporal.monthly_stats(views.kept(spark, sf)))


@register("quarterly_stats", _simple("quarter", "quarter(timestamp)::int"))
def quarterly_stats(spark, sf):
    return rounded(temporal.quarterly_stats(views.kept(spark, sf)))


# The shipping table spans several years, so it has all months and quarters.
@register(
    "monthly_and_quarterly_over_years",
    sql("""SELECT 'month' AS part, month(timestamp)::int AS value, """ + r("avg(actual)", 3) + " AS mean, " + r("median(actual)", 3)
        + " AS median, " + r("stddev_samp(actual)", 3) + """ AS std FROM scored GROUP BY 2
  UNION ALL SELECT 'quarter', quarter(timestamp)::int, """ + r("avg(actual)", 3) + ", " + r("median(actual)", 3) + ", "
        + r("stddev_samp(actual)", 3) + " FROM scored GROUP BY 2"),
)
def monthly_and_quarterly_over_years(spark, sf):
    s = views.scored(spark, sf)
    months = temporal.monthly_stats(s, "actual").select(F.lit("month").alias("part"), F.col("month").alias("value"), "mean", "median", "std")
    quarters = temporal.quarterly_stats(s, "actual").select(F.lit("quarter").alias("part"), F.col("quarter").alias("value"), "mean", "median", "std")
    return rounded(months.unionByName(quarters), 3)


@register(
    "seasonal_summary",
    sql("SELECT arg_max(h, (m, -h)) AS peak_month, arg_min(h, (m, h)) AS low_month, " + r("stddev_samp(m)", 4)
        + " AS seasonal_variance FROM (SELECT month(timestamp)::int AS h, avg(actual) AS m FROM scored GROUP BY 1)"),
)
def seasonal_summary(spark, sf):
    return rounded(temporal.seasonal_summary(views.scored(spark, sf), "actual"), 4)


@register(
    "weekend_summary",
    sql("SELECT " + r("wd") + " AS weekday_average, " + r("we") + " AS weekend_average, "
        + r("CASE WHEN wd > 0 THEN we / wd ELSE 0 END") + """ AS weekend_ratio FROM (
  SELECT avg(meter_reading) FILTER (WHERE isodow(timestamp) < 6) AS wd,
    avg(meter_reading) FILTER (WHERE isodow(timestamp) >= 6) AS we FROM kept)"""),
)
def weekend_summary(spark, sf):
    return rounded(temporal.weekend_summary(views.kept(spark, sf)))


@register(
    "temporal_summary",
    sql('SELECT count(*) AS total_records, min(timestamp) AS start, max(timestamp) AS "end", count(DISTINCT building_id) AS unique_buildings, '
        "floor(epoch(max(timestamp) - min(timestamp)) / 86400)::bigint AS days FROM kept"),
)
def temporal_summary(spark, sf):
    return temporal.temporal_summary(views.kept(spark, sf))


_BUILDING = (
    "stats AS (SELECT building_id, avg(meter_reading) AS mean, median(meter_reading) AS median, stddev_samp(meter_reading) AS std, "
    "min(meter_reading) AS min, max(meter_reading) AS max, quantile_cont(meter_reading, 0.25) AS q25, "
    "quantile_cont(meter_reading, 0.75) AS q75, count(meter_reading) AS count, "
    "count(*) FILTER (WHERE meter_reading IS NULL) AS missing_count FROM readings GROUP BY 1), "
    "parsed AS (SELECT *, stddev / nullif(mean, 0) AS cv FROM (SELECT *, std AS stddev, "
    "CASE WHEN len(string_split(building_id, '_')) >= 3 THEN string_split(building_id, '_')[1] ELSE 'unknown' END AS site, "
    "CASE WHEN len(string_split(building_id, '_')) >= 3 THEN string_split(building_id, '_')[2] ELSE 'unknown' END AS use_type FROM stats)) "
)


def _over_buildings(body: str) -> str:
    return views.CTE.rstrip() + ", " + _BUILDING + body


_STATS = _over_buildings(
    "SELECT building_id, " + ", ".join(r(c) + f" AS {c}" for c in ("mean", "median", "std", "min", "max", "q25", "q75", "cv"))
    + ", count, missing_count, " + r("missing_count / nullif(count, 0) * 100") + " AS missing_pct, "
    + r("missing_count / (count + missing_count)") + " AS missing_share, " + r("max - min") + " AS range, "
    + r("q75 - q25") + " AS iqr FROM parsed"
)


@register("building_stats", _STATS)
def building_stats(spark, sf):
    return rounded(building.building_stats(views.readings(spark, sf)))


@register("building_stats_split", _STATS)
def building_stats_split(spark, sf):
    """The same with every building treated as too large for one task."""
    return rounded(building.building_stats(views.readings(spark, sf), limit=20))


def _rollup(key: str, extra: str = "") -> str:
    return _over_buildings(
        f"SELECT {key}, " + r("avg(mean)") + " AS mean_mean, " + r("stddev_samp(mean)") + " AS mean_std, count(mean) AS mean_count, "
        + r("avg(median)") + f" AS median_mean{extra} FROM parsed GROUP BY 1"
    )


@register("use_type_stats", _rollup("use_type", ", " + r("avg(cv)") + " AS cv_mean"))
def use_type_stats(spark, sf):
    return rounded(building.by_use_type(building.building_stats(views.readings(spark, sf))))


@register("site_stats", _rollup("site"))
def site_stats(spark, sf):
    return rounded(building.by_site(building.building_stats(views.readings(spark, sf))))


@register("use_type_counts", _over_buildings("SELECT use_type, count(*) AS buildings FROM parsed GROUP BY 1"))
def use_type_counts(spark, sf):
    return building.value_counts(building.parsed_buildings(views.readings(spark, sf)).select("building_id"), "use_type")


@register("site_counts", _over_buildings("SELECT site, count(*) AS buildings FROM parsed GROUP BY 1"))
def site_counts(spark, sf):
    return building.value_counts(building.parsed_buildings(views.readings(spark, sf)).select("building_id"), "site")


@register(
    "use_type_extremes",
    _over_buildings("""SELECT arg_max(use_type, m) AS highest_consumption_use_type, arg_min(use_type, m) AS lowest_consumption_use_type
  FROM (SELECT use_type, avg(mean) AS m FROM parsed GROUP BY 1)"""),
)
def use_type_extremes(spark, sf):
    return building.extremes(building.by_use_type(building.building_stats(views.readings(spark, sf))), "use_type")


@register(
    "site_extremes",
    _over_buildings("""SELECT arg_max(site, m) AS highest_consumption_site, arg_min(site, m) AS lowest_consumption_site
  FROM (SELECT site, avg(mean) AS m FROM parsed GROUP BY 1)"""),
)
def site_extremes(spark, sf):
    return building.extremes(building.by_site(building.building_stats(views.readings(spark, sf))), "site")


@register("high_variance_buildings", _over_buildings("SELECT building_id, " + r("cv") + " AS cv FROM parsed WHERE cv > 1"))
def high_variance_buildings(spark, sf):
    return rounded(building.high_variance(building.building_stats(views.readings(spark, sf)), 1.0))


@register(
    "building_summary",
    _over_buildings("SELECT count(*) AS total_buildings, count(DISTINCT site) AS unique_sites, count(DISTINCT use_type) AS unique_use_types, "
                    + r("avg(mean)") + " AS avg_consumption, " + r("median(median)") + " AS median_consumption FROM parsed"),
)
def building_summary(spark, sf):
    return rounded(building.building_summary(building.building_stats(views.readings(spark, sf))))


_METER = (
    "SELECT meter, count(DISTINCT building_id) AS n_buildings, count(DISTINCT timestamp) AS n_readings, " + r("avg(meter_reading)")
    + " AS mean, " + r("median(meter_reading)") + " AS median, " + r("stddev_pop(meter_reading)") + " AS std, "
    + r("min(meter_reading)") + " AS min, " + r("max(meter_reading)") + " AS max, " + r("quantile_cont(meter_reading, 0.25)")
    + " AS q25, " + r("quantile_cont(meter_reading, 0.75)") + " AS q75 FROM kept_meters GROUP BY 1"
)


@register("meter_comparison", sql(_METER))
def meter_comparison(spark, sf):
    return rounded(meter.compare_meters(views.kept_meters(spark, sf)))


@register("meter_comparison_split", sql(_METER))
def meter_comparison_split(spark, sf):
    return rounded(meter.compare_meters(views.kept_meters(spark, sf), limit=100))


@register(
    "meter_distributions",
    sql("SELECT meter, " + r("skewness(meter_reading)") + " AS skewness, " + r("kurtosis(meter_reading)") + " AS kurtosis, "
        + r("stddev_pop(meter_reading) / avg(meter_reading)") + " AS cv, "
        + r("count(*) FILTER (WHERE meter_reading = 0) / count(*) * 100.0") + """ AS zero_pct
  FROM kept_meters WHERE meter_reading IS NOT NULL GROUP BY 1"""),
)
def meter_distributions(spark, sf):
    return rounded(meter.meter_distributions(views.kept_meters(spark, sf)))


_PAIRS = """per_building AS (SELECT a.meter AS meter_1, b.meter AS meter_2, a.building_id,
  corr(a.meter_reading, b.meter_reading) AS c FROM kept_meters a JOIN kept_meters b
  ON a.building_id = b.building_id AND a.timestamp = b.timestamp AND a.meter < b.meter
  WHERE a.meter_reading IS NOT NULL AND b.meter_reading IS NOT NULL GROUP BY 1, 2, 3
  HAVING count(*) > 1 AND min(a.meter_reading) < max(a.meter_reading) AND min(b.meter_reading) < max(b.meter_reading)) """


@register(
    "meter_pair_correlation",
    views.CTE.rstrip() + ", " + _PAIRS + "SELECT meter_1, meter_2, " + r("avg(c)") + " AS correlation, count(*) AS shared_buildings FROM per_building GROUP BY 1, 2",
)
def meter_pair_correlation(spark, sf):
    return rounded(meter.pair_correlations(views.kept_meters(spark, sf)))


@register(
    "correlated_meters",
    views.CTE.rstrip() + ", " + _PAIRS + "SELECT meter_1, meter_2, " + r("avg(c)") + " AS correlation, count(*) AS shared_buildings FROM per_building GROUP BY 1, 2 HAVING avg(c) > 0.1",
)
def correlated_meters(spark, sf):
    return rounded(meter.correlated_meters(views.kept_meters(spark, sf), 0.1))


@register(
    "meter_summary",
    sql("""SELECT string_agg(meter, ',' ORDER BY meter) AS meter_types_analyzed, sum(n)::bigint AS total_buildings
  FROM (SELECT meter, count(DISTINCT building_id) AS n FROM kept_meters GROUP BY 1)"""),
)
def meter_summary(spark, sf):
    return meter.meter_summary(views.kept_meters(spark, sf))


@register("shared_meter_buildings", sql("SELECT building_id FROM kept_meters WHERE meter = 'click' INTERSECT SELECT building_id FROM kept_meters WHERE meter = 'error'"))
def shared_meter_buildings(spark, sf):
    return meter.shared_buildings(views.kept_meters(spark, sf), "click", "error")


_ZSCORE = """SELECT k.building_id, k.timestamp, k.meter_reading,
  coalesce(abs((meter_reading - m) / nullif(s, 0)) > 3, false) AS is_anomaly FROM kept k
  JOIN (SELECT hour(timestamp) AS h, avg(meter_reading) AS m, stddev_samp(meter_reading) AS s FROM kept GROUP BY 1) a
  ON a.h = hour(k.timestamp)"""


@register("hourly_anomalies", sql(_ZSCORE))
def hourly_anomalies(spark, sf):
    return temporal.detect_anomalies(views.kept(spark, sf).select("building_id", "timestamp", "meter_reading"))


@register("hourly_anomalies_by_bounds", sql(_ZSCORE.replace("coalesce(abs((meter_reading - m) / nullif(s, 0)) > 3, false)", "coalesce(meter_reading > m + 3 * s OR meter_reading < m - 3 * s, false)")))
def hourly_anomalies_by_bounds(spark, sf):
    return temporal.detect_anomalies(views.kept(spark, sf).select("building_id", "timestamp", "meter_reading"), "bounds")


# --- quality ---------------------------------------------------------------------------------------------------------

_MERGED = """merged AS (SELECT k.building_id, k.timestamp, k.meter, k.meter_reading, m.site_id, m.floor_count, w.air_temperature
  FROM kept k LEFT JOIN metadata m ON m.building_id = k.building_id
  LEFT JOIN weather w ON w.site_id = m.site_id AND w.timestamp = k.timestamp) """


def _merged(spark, sf):
    meta = views.metadata(spark, sf).select("building_id", "site_id", "floor_count")
    weather = views.weather(spark, sf).select("site_id", "timestamp", "air_temperature")
    return merge_all(views.kept(spark, sf).drop("ord"), meta, weather)


@register(
    "missing_by_column",
    views.CTE.rstrip() + ", " + _MERGED + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + r(f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100.0") + " AS missing_pct FROM merged"
        for c in ("building_id", "timestamp", "meter", "meter_reading", "site_id", "floor_count", "air_temperature")
    ),
)
def missing_by_column(spark, sf):
    return rounded(quality.column_missing(_merged(spark, sf), above=None))


@register(
    "columns_mostly_missing",
    views.CTE.rstrip() + ", " + _MERGED + ", shares AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + r(f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100.0") + " AS missing_pct FROM merged"
        for c in ("building_id", "timestamp", "meter", "meter_reading", "site_id", "floor_count", "air_temperature")
    ) + ") SELECT * FROM shares WHERE missing_pct > 10",
)
def columns_mostly_missing(spark, sf):
    return rounded(quality.column_missing(_merged(spark, sf)))


@register(
    "run_summary",
    views.CTE.rstrip() + ", " + _MERGED + 'SELECT count(*) AS rows, 7 AS columns, count(DISTINCT building_id) AS buildings, '
    'count(DISTINCT site_id) AS sites, min(timestamp) AS start, max(timestamp) AS "end", ' + r("avg(meter_reading)")
    + " AS mean_reading, " + r("median(meter_reading)") + " AS median_reading FROM merged",
)
def run_summary(spark, sf):
    return rounded(quality.run_summary(_merged(spark, sf)))


_AT = """cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT timestamp AS t FROM kept)) WHERE rn = floor(0.8 * n) + 1) """


@register(
    "split_summary",
    views.CTE.rstrip() + ", " + _AT + """SELECT CASE WHEN timestamp < t THEN 'train' ELSE 'test' END AS part, count(*) AS rows,
  min(timestamp) AS start, max(timestamp) AS "end", """ + r("count(*) / (SELECT count(*) FROM kept) * 100.0") + " AS row_pct FROM kept, cut GROUP BY 1",
)
def split_summary(spark, sf):
    return rounded(quality.split_summary(*time_split(views.kept(spark, sf))))


_CONTINUITY = """SELECT {0} expected_count, actual_count, expected_count - on_grid AS missing_count,
  actual_count - on_grid AS extra_count, """ + r("actual_count / expected_count * 100.0") + """ AS completeness FROM (
  SELECT {0} (epoch(max(t) - min(t)) / 3600)::bigint + 1 AS expected_count, count(*) AS actual_count, count(*) AS on_grid
  FROM (SELECT DISTINCT building_id, timestamp AS t FROM kept) {1})"""


@register("timestamp_continuity", sql("""SELECT e AS expected_count, a AS actual_count, e - a AS missing_count, 0::bigint AS extra_count,
  """ + r("a / e * 100.0") + """ AS completeness FROM (SELECT (epoch(max(timestamp) - min(timestamp)) / 3600)::bigint + 1 AS e,
  count(DISTINCT timestamp) AS a FROM kept)"""))
def timestamp_continuity(spark, sf):
    return rounded(quality.continuity(views.kept(spark, sf)))


@register("timestamp_continuity_per_building", sql(_CONTINUITY.format("building_id,", "GROUP BY 1")))
def timestamp_continuity_per_building(spark, sf):
    return rounded(quality.continuity(views.kept(spark, sf), ["building_id"]))


@register(
    "event_time_continuity",
    """WITH t AS (SELECT DISTINCT date_trunc('minute', ts) AS t FROM events),
b AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
g AS (SELECT floor(epoch(hi - lo) / 3600)::bigint + 1 AS e, count(*) FILTER (WHERE (epoch(t - lo)::bigint) % 3600 = 0) AS o, count(*) AS a FROM t, b GROUP BY 1)
SELECT e AS expected_count, a AS actual_count, e - o AS missing_count, a - o AS extra_count, """ + r("a / e * 100.0") + " AS completeness FROM g",
)
def event_time_continuity(spark, sf):
    """Minute-level timestamps against an hourly expectation: nearly all of them are extra."""
    minutes = views.table(spark, sf, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"))
    return rounded(quality.continuity(minutes))


@register(
    "missing_timestamps",
    sql("""SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM (
  SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM kept) EXCEPT SELECT timestamp FROM kept"""),
)
def missing_timestamps(spark, sf):
    return quality.missing_timestamps(views.kept(spark, sf))


_GAPS = """missing AS (SELECT building_id, timestamp FROM grid EXCEPT SELECT building_id, timestamp FROM kept),
gaps AS (SELECT building_id, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) AS missing_steps FROM (
  SELECT *, timestamp - to_hours(row_number() OVER (PARTITION BY building_id ORDER BY timestamp)) AS island FROM missing)
  GROUP BY building_id, island) """


@register("reading_gap_intervals", views.CTE.rstrip() + ", " + _GAPS + "SELECT * FROM gaps")
def reading_gap_intervals(spark, sf):
    return gap_intervals(views.kept(spark, sf))


@register("reading_gap_intervals_split", views.CTE.rstrip() + ", " + _GAPS + "SELECT * FROM gaps")
def reading_gap_intervals_split(spark, sf):
    """The same by the path for groups too large for one task (buildings of over 100 rows count as such here)."""
    return gap_intervals(views.kept(spark, sf), limit=100)


@register(
    "reading_gap_summary",
    views.CTE.rstrip() + ", " + _GAPS + """SELECT building_id, count(*) AS gaps, sum(missing_steps)::bigint AS missing_steps,
  max(missing_steps) AS longest_gap, first(gap_start ORDER BY missing_steps DESC, gap_start) AS longest_gap_start
  FROM gaps GROUP BY 1""",
)
def reading_gap_summary(spark, sf):
    return quality.gap_summary(views.kept(spark, sf))


@register("missing_timestamps_per_building", views.CTE.rstrip() + ", " + _GAPS + "SELECT * FROM missing")
def missing_timestamps_per_building(spark, sf):
    return quality.missing_times_by_group(views.kept(spark, sf))


@register(
    "extra_timestamps",
    """WITH t AS (SELECT DISTINCT date_trunc('minute', ts) AS timestamp FROM events)
SELECT timestamp FROM t EXCEPT SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) FROM (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM t)""",
)
def extra_timestamps(spark, sf):
    minutes = views.table(spark, sf, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"))
    return quality.extra_timestamps(minutes)


@register(
    "cleaning_counts",
    sql("""SELECT n::bigint AS initial_rows, neg::bigint AS negatives, zero::bigint AS zeros, nul::bigint AS missing,
  (n - neg - f)::bigint AS duplicates, f::bigint AS final_rows, """ + r("(n - f) / n * 100.0") + """ AS removed_pct FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE meter_reading < 0) AS neg, count(*) FILTER (WHERE meter_reading = 0) AS zero,
    count(*) FILTER (WHERE meter_reading IS NULL) AS nul, (SELECT count(*) FROM kept_meters) AS f FROM readings)"""),
)
def cleaning_counts_query(spark, sf):
    return rounded(cleaning_counts(views.readings(spark, sf)))


@register(
    "distinct_values",
    views.CTE.rstrip() + ", " + _MERGED + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM merged" for c in ("building_id", "site_id", "meter")
    ),
)
def distinct_values(spark, sf):
    return quality.distinct_values(_merged(spark, sf), ["building_id", "site_id", "meter"])


@register(
    "quality_checks",
    sql("""SELECT c.check, c.observed, c.limit, c.observed <= c.limit AS passed FROM (SELECT unnest([
  {'check': 'schema_validation', 'observed': 0::double, 'limit': 0::double},
  {'check': 'missing_values', 'observed': """ + r("nul / n") + """, 'limit': 0.3::double},
  {'check': 'duplicate_rows', 'observed': """ + r("dup / n") + """, 'limit': 0.01::double},
  {'check': 'timestamp_gaps', 'observed': gaps::double, 'limit': 0::double},
  {'check': 'negative_readings', 'observed': neg::double, 'limit': 0::double},
  {'check': 'outliers', 'observed': outl::double, 'limit': 0::double}]) AS c FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE meter_reading IS NULL) AS nul, count(*) FILTER (WHERE meter_reading < 0) AS neg,
    count(*) - count(DISTINCT (building_id, timestamp, meter)) AS dup,
    (epoch(max(timestamp) - min(timestamp)) / 3600)::bigint + 1 - count(DISTINCT timestamp) AS gaps,
    count(*) FILTER (WHERE meter_reading < q1 - 3 * (q3 - q1) OR meter_reading > q3 + 3 * (q3 - q1)) AS outl
  FROM readings, (SELECT quantile_cont(meter_reading, 0.25) AS q1, quantile_cont(meter_reading, 0.75) AS q3 FROM readings) q))"""),
)
def quality_checks(spark, sf):
    return rounded(quality.quality_checks(views.readings(spark, sf), ["building_id", "timestamp", "meter", "meter_reading"]))


@register(
    "exact_quantiles_split",
    "SELECT l_returnflag AS flag, " + ", ".join(
        r(f"quantile_cont(l_extendedprice, {p})", 4) + f" AS {n}" for n, p in (("p01", 0.01), ("p50", 0.5), ("p90", 0.9), ("p999", 0.999))
    ) + " FROM lineitem GROUP BY 1",
)
def exact_quantiles_split(spark, sf):
    """Interpolated quantiles by radix selection."""
    rows = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    wanted = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    return rounded(exact_quantiles(rows, ["flag"], "l_extendedprice", wanted, limit=1000), 4)


@register(
    "tied_quantiles_split",
    "SELECT l_linestatus AS mode, count(*) AS n, " + r("avg(l_discount)") + " AS mean, " + ", ".join(
        r(f"quantile_cont(l_discount - 0.05, {p})", 6) + f" AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    ) + " FROM lineitem GROUP BY 1",
)
def tied_quantiles_split(spark, sf):
    """Quantiles of eleven values on both sides of zero, each shared by a large part of a group, beside other aggregates."""
    rows = views.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("mode"), "l_discount", (F.col("l_discount") - 0.05).alias("shifted"))
    wanted = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75}
    out = grouped_stats(rows, ["mode"], [F.count("*").alias("n"), F.avg("l_discount").alias("mean")], "shifted", wanted, limit=1000)
    return rounded(out, 6)


@register("report_as_json", sql("""SELECT '{"building_id":"' || building_id || '","n":' || n || ',"known":' || known || ',"top":' ||
  coalesce(top::varchar, 'null') || '}' AS json FROM (SELECT building_id, count(*) AS n, count(meter_reading) > 0 AS known,
  max(ord) FILTER (WHERE meter = 'purchase') AS top FROM readings GROUP BY 1)"""))
def report_as_json(spark, sf):
    stats = views.readings(spark, sf).groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count("meter_reading") > 0).alias("known"),
        F.max(F.when(F.col("meter") == "purchase", F.col("ord"))).alias("top"),
    )
    return as_json(stats)


@register(
    "missingness_by_hour_and_building",
    sql("SELECT building_id, hour(timestamp)::int AS hour, " + r("count(*) FILTER (WHERE meter_reading IS NULL) / count(*) * 100.0") + " AS missing_pct FROM grid GROUP BY 1, 2"),
)
def missingness_by_hour_and_building(spark, sf):
    """Input of a missingness plot, on the hourly grid."""
    return rounded(
        views.grid(spark, sf)
        .groupBy("building_id", F.hour("timestamp").alias("hour"))
        .agg((F.count_if(F.col("meter_reading").isNull()) / F.count(F.lit(1)) * 100.0).alias("missing_pct"))
    )


@register(
    "outliers_per_building",
    views.CTE.rstrip() + """, b AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(meter_reading, 0.25) AS q1, quantile_cont(meter_reading, 0.75) AS q3 FROM kept))
SELECT building_id, count(*) FILTER (WHERE meter_reading < lo OR meter_reading > hi) AS outliers FROM kept, b GROUP BY 1""",
)
def outliers_per_building(spark, sf):
    """Input of an outlier plot."""
    flagged = handle_outliers(views.kept(spark, sf), action="flag")
    return flagged.groupBy("building_id").agg(F.count_if("is_outlier").alias("outliers"))
