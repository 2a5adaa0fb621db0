"""Feature, split, metric and model queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.calendar import add_calendar_features, add_extended_calendar, add_profile_calendar
from ..functions.columns import at_least
from ..models import baselines, boosted, linear, metrics, regimes
from ..models.additive import AdditiveModel, fit_additive, tune_additive
from ..operators import features, joins, splits, windows
from ..operators.skew import first_per_key, needs_split
from ..plans.preparation import build_features, prepare
from ..plans.scored import score_buildings
from ..plans.training import client_round_metrics
from ..reports.quality import correlation_matrix
from ..session import cut_lineage, scratch_path
from ..sources.files import write_parquet
from . import views
from .registry import register
from .views import r, rounded, sql

# --- calendar, weather and building features -------------------------------------------------------------------------

_TAU = "2 * pi()"
_CALENDAR = (
    "hour(timestamp)::int AS hour, day(timestamp)::int AS day, (isodow(timestamp) - 1)::int AS dayofweek, "
    "month(timestamp)::int AS month, year(timestamp)::int AS year, dayofyear(timestamp)::int AS dayofyear, "
    "(isodow(timestamp) >= 6)::int AS is_weekend"
)
_CYCLES = ", ".join(
    r(f"{f}({_TAU} * {x} / {p})") + f" AS {n}_{f}"
    for n, x, p in (("hour", "hour(timestamp)", 24), ("dayofweek", "(isodow(timestamp) - 1)", 7), ("month", "month(timestamp)", 12))
    for f in ("sin", "cos")
)


@register("calendar_features", sql(f"SELECT building_id, timestamp, {_CALENDAR}, {_CYCLES} FROM kept"))
def calendar_features(spark, sf):
    return rounded(add_calendar_features(views.kept(spark, sf).select("building_id", "timestamp")))


@register(
    "profile_calendar",
    """SELECT l_orderkey, l_linenumber, l_shipdate AS timestamp, hour(l_shipdate)::int AS hour, (isodow(l_shipdate) - 1)::int AS day_of_week,
  day(l_shipdate)::int AS day_of_month, month(l_shipdate)::int AS month, quarter(l_shipdate)::int AS quarter,
  dayofyear(l_shipdate)::int AS day_of_year, week(l_shipdate)::int AS week_of_year, isodow(l_shipdate) >= 6 AS is_weekend,
  day(l_shipdate) = 1 AS is_month_start, l_shipdate::date = last_day(l_shipdate) AS is_month_end FROM lineitem""",
)
def profile_calendar(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("timestamp"))
    return add_profile_calendar(rows)


@register(
    "extended_calendar",
    """WITH d AS (SELECT DISTINCT o_orderdate AS timestamp FROM orders)
SELECT timestamp, quarter(timestamp)::int AS quarter, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter'
  WHEN month(timestamp) <= 5 THEN 'spring' WHEN month(timestamp) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
  (strftime(timestamp, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25')
   OR (month(timestamp) IN (1, 2) AND isodow(timestamp) = 1 AND (day(timestamp) - 1) // 7 = 2)
   OR (month(timestamp) = 5 AND isodow(timestamp) = 1 AND month(timestamp + INTERVAL 7 DAY) = 6)
   OR (month(timestamp) = 9 AND isodow(timestamp) = 1 AND (day(timestamp) - 1) // 7 = 0)
   OR (month(timestamp) = 10 AND isodow(timestamp) = 1 AND (day(timestamp) - 1) // 7 = 1)
   OR (month(timestamp) = 11 AND isodow(timestamp) = 4 AND (day(timestamp) - 1) // 7 = 3)
   OR (strftime(timestamp, '%m-%d') = '06-19' AND year(timestamp) >= 2021))::int AS is_holiday FROM d""",
)
def extended_calendar(spark, sf):
    days = views.table(spark, sf, "orders").select(F.col("o_orderdate").alias("timestamp")).distinct()
    return add_extended_calendar(days)


_RH = """CASE WHEN air_temperature IS NULL OR dew_temperature IS NULL THEN NULL ELSE least(100, greatest(0,
  100 * exp(17.625::double * dew_temperature / (243.04::double + dew_temperature)) / exp(17.625::double * air_temperature / (243.04::double + air_temperature)))) END"""


@register("relative_humidity", sql("SELECT site_id, timestamp, " + r(_RH) + " AS relative_humidity FROM weather_filled"))
def relative_humidity(spark, sf):
    return rounded(features.add_weather_features(views.weather_filled(spark, sf)).select("site_id", "timestamp", "relative_humidity"))


_ROLL = """avg(air_temperature) OVER (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"""
_WEATHER_ROLLING = sql(
    "SELECT site_id, timestamp, " + r("air_temperature") + " AS air_temperature, " + r("a") + " AS air_temperature_rolling_24h, " + r("b")
    + " AS air_temperature_rolling_72h, " + r("air_temperature - a") + f""" AS air_temperature_diff_24h_mean FROM (
  SELECT *, {_ROLL.format(23)} AS a, {_ROLL.format(71)} AS b FROM weather_filled)"""
)


@register("weather_rolling", _WEATHER_ROLLING)
def weather_rolling(spark, sf):
    rows = views.weather_filled(spark, sf).select("site_id", "timestamp", "air_temperature")
    return rounded(windows.add_weather_rolling(rows))


@register("weather_rolling_split", _WEATHER_ROLLING)
def weather_rolling_split(spark, sf):
    """The same with every site cut into chunks."""
    rows = views.weather_filled(spark, sf).select("site_id", "timestamp", "air_temperature")
    return rounded(windows.add_weather_rolling(rows, limit=150))


@register(
    "apparent_temperature",
    sql("SELECT site_id, timestamp, " + r(f"""air_temperature + ({_RH}) / 100 * 6.105::double * exp(17.27::double * air_temperature
  / (237.7::double + air_temperature)) * 0.33::double - wind_speed * 0.7::double - 4""") + " AS apparent_temperature FROM weather_filled"),
)
def apparent_temperature(spark, sf):
    w = features.add_weather_features(views.weather_filled(spark, sf))
    return rounded(features.add_comfort(w).select("site_id", "timestamp", "apparent_temperature"))


@register(
    "degree_days",
    sql("SELECT site_id, date, " + r("f") + " AS mean_temperature_f, " + r("CASE WHEN f > 65 THEN 0 ELSE 65 - f END")
        + " AS heating_degree_days, " + r("CASE WHEN f < 65 THEN 0 ELSE f - 65 END") + """ AS cooling_degree_days FROM (
  SELECT site_id, timestamp::date AS date, avg(air_temperature) * 9 / 5 + 32 AS f FROM weather_filled GROUP BY 1, 2)"""),
)
def degree_days(spark, sf):
    return rounded(features.degree_days(views.weather_filled(spark, sf)))


_TOP = """top AS (SELECT primary_use, count(*) AS count FROM metadata_clean GROUP BY 1 ORDER BY count(*) DESC, primary_use LIMIT 10) """


@register("top_uses", views.CTE.rstrip() + ", " + _TOP + "SELECT * FROM top")
def top_uses(spark, sf):
    return features.top_categories(views.metadata_clean(spark, sf), "primary_use")


@register(
    "grouped_uses",
    views.CTE.rstrip() + ", " + _TOP + """SELECT m.building_id, m.primary_use, coalesce(t.primary_use, 'other') AS primary_use_grouped
  FROM metadata_clean m LEFT JOIN top t ON t.primary_use = m.primary_use""",
)
def grouped_uses(spark, sf):
    m = views.metadata_clean(spark, sf).select("building_id", "primary_use")
    return features.group_categories(m, features.top_categories(m, "primary_use"))


@register(
    "use_dummies",
    sql("SELECT building_id, " + ", ".join(f"(primary_use = '{s}-0')::int AS \"use_{s}-0\"" for s in ("automobile", "building", "furniture", "household", "machinery")) + " FROM metadata_clean"),
)
def use_dummies(spark, sf):
    names = [f"{s}-0" for s in ("automobile", "building", "furniture", "household", "machinery")]
    m = views.metadata_clean(spark, sf).select("building_id", "primary_use")
    return features.one_hot(m, "primary_use", names).drop("primary_use")


@register("area_per_floor", sql("SELECT building_id, " + r("square_feet / nullif(coalesce(floor_count, 1), 0)") + " AS sqft_per_floor FROM metadata"))
def area_per_floor(spark, sf):
    m = views.metadata(spark, sf)
    out = features.add_building_features(m.withColumn("primary_use", F.lit("x")), features.top_categories(m, "primary_use"), ["x"])
    return rounded(out.select("building_id", "sqft_per_floor"))


@register(
    "interactions",
    sql("SELECT k.building_id, k.timestamp, " + r("w.air_temperature * hour(k.timestamp)") + """ AS air_temperature_x_hour,
  ((isodow(k.timestamp) >= 6)::int * hour(k.timestamp))::int AS is_weekend_x_hour
  FROM kept k LEFT JOIN metadata m ON m.building_id = k.building_id
  LEFT JOIN weather_filled w ON w.site_id = m.site_id AND w.timestamp = k.timestamp"""),
)
def interactions(spark, sf):
    rows = joins.merge_all(
        views.kept(spark, sf).select("building_id", "timestamp"),
        views.metadata(spark, sf).select("building_id", "site_id"),
        views.weather_filled(spark, sf).select("site_id", "timestamp", "air_temperature"),
    )
    out = features.add_interactions(add_calendar_features(rows))
    return rounded(out.select("building_id", "timestamp", "air_temperature_x_hour", "is_weekend_x_hour"))


# --- lags and windows ------------------------------------------------------------------------------------------------

_W = "PARTITION BY building_id ORDER BY timestamp"


def _lag(n: int) -> str:
    return f"lag(meter_reading, {n}) OVER ({_W})"


def _rolled(function: str, n: int) -> str:
    return f"{function}(meter_reading) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_BASE = "building_id, timestamp, meter_reading"


def _readings(spark, sf):
    return views.kept(spark, sf).select("building_id", "timestamp", "meter_reading")


@register("lag_features", sql(f"SELECT {_BASE}, " + ", ".join(f"{_lag(n)} AS meter_reading_lag_{n}h" for n in (1, 24, 168)) + " FROM kept"))
def lag_features(spark, sf):
    return windows.add_lag_features(_readings(spark, sf))


@register("lag_features_on_grid", sql(f"SELECT {_BASE}, " + ", ".join(f"{_lag(n)} AS meter_reading_lag_{n}h" for n in (1, 24, 168)) + " FROM grid"))
def lag_features_on_grid(spark, sf):
    """Lags in hours: the readings are put on a gap-free grid first."""
    return windows.add_lag_features(_readings(spark, sf), align="time")


_SQL_NAMES = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_ROLLING = ", ".join(
    r(_rolled(_SQL_NAMES[f], n)) + f" AS meter_reading_rolling_{n}h_{f}"
    for n, fs in ((24, ("mean", "std", "min", "max")), (168, ("mean", "std")))
    for f in fs
)


@register("rolling_features", sql(f"SELECT {_BASE}, {_ROLLING} FROM kept"))
def rolling_features(spark, sf):
    return rounded(windows.add_rolling_features(_readings(spark, sf)))


@register("rolling_features_split", sql(f"SELECT {_BASE}, {_ROLLING} FROM kept"))
def rolling_features_split(spark, sf):
    """The same with every building cut into chunks with border rows."""
    return rounded(windows.add_rolling_features(_readings(spark, sf), limit=20))


@register("rolling_features_on_grid", sql(f"SELECT {_BASE}, {_ROLLING} FROM grid"))
def rolling_features_on_grid(spark, sf):
    return rounded(windows.add_rolling_features(_readings(spark, sf), align="time"))


@register("difference_features", sql(f"SELECT {_BASE}, " + ", ".join(r(f"meter_reading - {_lag(n)}") + f" AS meter_reading_diff_{n}h" for n in (1, 24)) + " FROM kept"))
def difference_features(spark, sf):
    return rounded(windows.add_diff_features(_readings(spark, sf)))


_EXPANDING = ", ".join(
    r(f"{_SQL_NAMES[f]}(meter_reading) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") + f" AS meter_reading_expanding_{f}"
    for f in ("mean", "std", "min", "max")
)


@register("expanding_features", sql(f"SELECT {_BASE}, {_EXPANDING} FROM kept"))
def expanding_features(spark, sf):
    return rounded(windows.add_expanding_features(_readings(spark, sf), functions=("mean", "std", "min", "max")))


@register("expanding_features_split", sql(f"SELECT {_BASE}, {_EXPANDING} FROM kept"))
def expanding_features_split(spark, sf):
    """The same with the moments of earlier chunks carried forward."""
    return rounded(windows.add_expanding_features(_readings(spark, sf), functions=("mean", "std", "min", "max"), limit=20))


@register(
    "all_temporal_features",
    sql(f"SELECT {_BASE}, " + ", ".join(r(_lag(n)) + f" AS meter_reading_lag_{n}h" for n in (1, 24, 168)) + f", {_ROLLING}, "
        + ", ".join(r(f"meter_reading - {_lag(n)}") + f" AS meter_reading_diff_{n}h" for n in (1, 24)) + ", "
        + ", ".join(r(f"{_SQL_NAMES[f]}(meter_reading) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") + f" AS meter_reading_expanding_{f}" for f in ("mean", "std"))
        + " FROM kept"),
)
def all_temporal_features(spark, sf):
    return rounded(windows.add_temporal_features(_readings(spark, sf), diffs=(1, 24), expanding=("mean", "std")))


_FEATURES = views.CTE.rstrip() + """, wx AS (SELECT *, """ + _RH + f""" AS relative_humidity, {_ROLL.format(23)} AS t24, {_ROLL.format(71)} AS t72
  FROM weather_filled),
feat AS (SELECT k.building_id, k.timestamp, k.meter, k.meter_reading, k.ord, m.site_id, m.primary_use, m.square_feet, m.year_built,
  m.floor_count, m.building_age, m.log_square_feet, x.air_temperature, x.dew_temperature, x.wind_speed, x.sea_level_pressure,
  x.relative_humidity, x.t24, x.t72, {_lag(1)} AS l1, {_lag(24)} AS l24, {_rolled('avg', 24)} AS r24
  FROM kept k LEFT JOIN metadata_clean m USING (building_id) LEFT JOIN wx x ON x.site_id = m.site_id AND x.timestamp = k.timestamp) """.replace(
    "OVER (PARTITION BY building_id ORDER BY timestamp", "OVER (PARTITION BY k.building_id ORDER BY k.timestamp").replace(
    "OVER (PARTITION BY site_id ORDER BY timestamp", "OVER (PARTITION BY site_id ORDER BY timestamp")


@register(
    "feature_table",
    _FEATURES + f"SELECT building_id, timestamp, meter, meter_reading, ord, site_id, primary_use, {_CALENDAR}, {_CYCLES}, year_built, floor_count, building_age, "
    + ", ".join(r(c) + f" AS {n}" for c, n in (
        ("square_feet", "square_feet"), ("log_square_feet", "log_square_feet"), ("air_temperature", "air_temperature"),
        ("dew_temperature", "dew_temperature"), ("wind_speed", "wind_speed"), ("sea_level_pressure", "sea_level_pressure"),
        ("relative_humidity", "relative_humidity"), ("t24", "air_temperature_rolling_24h"), ("t72", "air_temperature_rolling_72h"),
        ("air_temperature - t24", "air_temperature_diff_24h_mean"), ("l1", "meter_reading_lag_1h"), ("l24", "meter_reading_lag_24h"),
        ("r24", "meter_reading_rolling_24h_mean"), ("square_feet / nullif(coalesce(floor_count, 1), 0)", "sqft_per_floor")))
    + """, primary_use AS primary_use_grouped, (primary_use = 'machinery-0')::int AS "use_machinery-0" FROM feat
  WHERE meter_reading IS NOT NULL AND l1 IS NOT NULL AND l24 IS NOT NULL AND r24 IS NOT NULL AND t24 IS NOT NULL AND t72 IS NOT NULL""",
)
def feature_table(spark, sf):
    """Raw tables to model features: cleaning, joins, calendar, weather, building and history columns.

    The use ranking is given as all categories, so that the dummy columns do not depend on the data.
    """
    readings = views.readings(spark, sf)
    split = needs_split(readings, ["building_id"])
    cleaned = prepare(
        readings, views.metadata(spark, sf), views.weather(spark, sf), views.REFERENCE_YEAR,
        "2024-01-01", "2024-12-31", "all", split=split,
    )
    one_per_hour = first_per_key(cleaned, ["building_id", "timestamp"], ["ord"])
    uses = views.metadata_clean(spark, sf).groupBy("primary_use").count()
    # One series for each building here, whatever the meter of its first reading of an hour.
    series = build_features(one_per_hour, group_cols=("building_id",), top_uses=uses, use_values=["machinery-0"], split=split)
    return rounded(series)


@register(
    "feature_table_by_meter",
    sql(""", base AS (SELECT k.*, m.primary_use FROM kept_meters k LEFT JOIN metadata_clean m ON m.building_id = k.building_id),
top AS (SELECT primary_use FROM base WHERE primary_use IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, primary_use LIMIT 10),
past AS (SELECT *, lag(meter_reading) OVER w AS l1,
    avg(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS r2
  FROM base WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp))
SELECT p.building_id, p.timestamp, p.meter, """ + r("p.meter_reading") + " AS meter_reading, " + r("l1") + " AS meter_reading_lag_1h, "
        + r("r2") + """ AS meter_reading_rolling_2h_mean, coalesce(t.primary_use, 'other') AS primary_use_grouped,
  1 AS dummies_set, (SELECT count(*) + 1 FROM top)::int AS dummy_columns
FROM past p LEFT JOIN top t ON t.primary_use = p.primary_use
WHERE p.meter_reading IS NOT NULL AND l1 IS NOT NULL AND r2 IS NOT NULL"""),
)
def feature_table_by_meter(spark, sf):
    """All meters: history of each building's meter, the ten most frequent uses and `other`, and their dummy columns."""
    uses = views.metadata_clean(spark, sf).select("building_id", "primary_use")
    rows = joins.attach_metadata(views.kept_meters(spark, sf), uses)
    out = build_features(rows, lags=(1,), rolling=((2, ("mean",)),), strict=False)
    dummies = [c for c in out.columns if c.startswith("use_")]
    total = sum((F.col(f"`{c}`") for c in dummies), F.lit(0))
    return rounded(
        out.select(
            "building_id", "timestamp", "meter", "meter_reading", "meter_reading_lag_1h", "meter_reading_rolling_2h_mean",
            "primary_use_grouped", total.alias("dummies_set"), F.lit(len(dummies)).alias("dummy_columns"),
        )
    )


@register(
    "warm_up_dropped",
    sql(f"SELECT * FROM (SELECT {_BASE}, {_lag(1)} AS meter_reading_lag_1h, {_lag(24)} AS meter_reading_lag_24h, "
        + r(_rolled("avg", 24)) + """ AS meter_reading_rolling_24h_mean FROM kept) WHERE meter_reading IS NOT NULL
  AND meter_reading_lag_1h IS NOT NULL AND meter_reading_lag_24h IS NOT NULL AND meter_reading_rolling_24h_mean IS NOT NULL"""),
)
def warm_up_dropped(spark, sf):
    out = windows.add_temporal_features(_readings(spark, sf), lags=(1, 24), rolling=((24, ("mean",)),))
    return rounded(features.drop_warm_up(out))


# --- splits ----------------------------------------------------------------------------------------------------------

_CUT = """cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT timestamp AS t FROM {0})) WHERE rn = floor(0.8 * n) + 1) """


@register("time_split_point", views.CTE.rstrip() + ", " + _CUT.format("kept") + "SELECT t AS split_timestamp FROM cut")
def time_split_point(spark, sf):
    return splits.split_time(views.kept(spark, sf))


@register("time_split_rows", views.CTE.rstrip() + ", " + _CUT.format("kept") + "SELECT building_id, timestamp, timestamp < t AS is_train FROM kept, cut")
def time_split_rows(spark, sf):
    train, test = splits.time_split(views.kept(spark, sf).select("building_id", "timestamp"))
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


_CLIENT_SPLIT = """marked AS (SELECT l_suppkey AS client, l_shipdate AS timestamp, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
  l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1
    < floor(0.8 * count(*) OVER (PARTITION BY l_suppkey)) AS is_train FROM lineitem) """


@register("client_split_rows", "WITH " + _CLIENT_SPLIT + "SELECT client, timestamp, l_orderkey, l_linenumber, is_train FROM marked")
def client_split_rows(spark, sf):
    return _client_rows(spark, sf).select("client", "timestamp", "l_orderkey", "l_linenumber", "is_train")


@register("client_split_rows_split", "WITH " + _CLIENT_SPLIT + "SELECT client, timestamp, l_orderkey, l_linenumber, is_train FROM marked")
def client_split_rows_split(spark, sf):
    """The same with every client numbered over range partitions."""
    return _client_rows(spark, sf, limit=10).select("client", "timestamp", "l_orderkey", "l_linenumber", "is_train")


def _client_rows(spark, sf, **options):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("client"), F.col("l_shipdate").alias("timestamp"), "l_orderkey", "l_linenumber",
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )
    return splits.mark_client_split(rows, "client", ["timestamp", "l_orderkey", "l_linenumber"], **options)


@register(
    "held_out_sites",
    sql("""SELECT site_id FROM (SELECT site_id, row_number() OVER (ORDER BY md5(site_id || '|42')) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT site_id FROM ids)) WHERE r <= floor(0.2 * n)"""),
)
def held_out_sites(spark, sf):
    return splits.held_out_sites(views.ids(spark, sf))


@register(
    "unseen_site_rows",
    sql("""SELECT building_id, site_id, site_id IN (SELECT site_id FROM (SELECT site_id, row_number() OVER (ORDER BY md5(site_id || '|42')) AS r,
  count(*) OVER () AS n FROM (SELECT DISTINCT site_id FROM ids)) WHERE r <= floor(0.2 * n)) AS unseen FROM metadata"""),
)
def unseen_site_rows(spark, sf):
    seen, unseen = splits.site_split(views.metadata(spark, sf).select("building_id", "site_id"))
    return seen.withColumn("unseen", F.lit(False)).unionByName(unseen.withColumn("unseen", F.lit(True)))


_FOLDS = """span AS (SELECT min(year(timestamp) * 12 + month(timestamp) - 1) AS lo, max(year(timestamp) * 12 + month(timestamp) - 1) AS hi FROM scored),
folds AS (SELECT f::int AS fold, {start}::int AS train_from, (hi - (5 - f + 1))::int AS train_to, (hi - (5 - f + 1) + 1)::int AS test_from,
  (hi - (5 - f + 1) + 1)::int AS test_to FROM span, generate_series(1, 5) g(f)) """
_EXPANDING_FOLDS = views.CTE.rstrip() + ", " + _FOLDS.format(start="lo")
_ROLLING_FOLDS = views.CTE.rstrip() + ", " + _FOLDS.format(start="greatest(lo, hi - (5 - f + 1) - (hi - 5 - lo + 1) + 1)")


@register("rolling_folds", _ROLLING_FOLDS + "SELECT * FROM folds")
def rolling_folds(spark, sf):
    return splits.time_folds(views.scored(spark, sf))


@register("expanding_folds", _EXPANDING_FOLDS + "SELECT * FROM folds")
def expanding_folds(spark, sf):
    return splits.time_folds(views.scored(spark, sf), method="expanding")


@register(
    "fold_sizes",
    _ROLLING_FOLDS + """SELECT fold, role, count(*) AS n FROM (SELECT year(timestamp) * 12 + month(timestamp) - 1 AS m FROM scored) s JOIN
  (SELECT fold, 'train' AS role, train_from AS a, train_to AS b FROM folds UNION ALL SELECT fold, 'test', test_from, test_to FROM folds) f
  ON s.m BETWEEN f.a AND f.b GROUP BY 1, 2""",
)
def fold_sizes(spark, sf):
    s = views.scored(spark, sf)
    return splits.assign_folds(s, splits.time_folds(s)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


# --- metrics and baselines -------------------------------------------------------------------------------------------


def _metrics(actual: str = "actual", predicted: str = "prediction", digits: int = 6) -> str:
    e = f"({actual} - {predicted})"
    le = f"(ln(1 + greatest({actual}, 0)) - ln(1 + greatest({predicted}, 0)))"
    return (
        f"count(*) AS n, {r(f'sqrt(avg({e} * {e}))', digits)} AS rmse, {r(f'avg(abs({e}))', digits)} AS mae, "
        f"{r(f'sqrt(avg({le} * {le}))', digits)} AS rmsle, "
        f"{r(f'CASE WHEN count(*) < 2 THEN NULL WHEN var_pop({actual}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({actual}) * count(*)) WHEN sum({e} * {e}) = 0 THEN 1 ELSE 0 END', digits)} AS r2, "
        f"{r(f'avg(CASE WHEN {actual} <> 0 THEN abs({e} / {actual}) END) * 100', digits)} AS mape"
    )


@register("regression_metrics", sql(f"SELECT {_metrics(digits=4)} FROM scored"))
def regression_metrics(spark, sf):
    return rounded(metrics.evaluate(views.scored(spark, sf), "actual", "prediction"), 4)


@register("metrics_per_client", sql(f"SELECT client, {_metrics(digits=4)} FROM scored GROUP BY 1"))
def metrics_per_client(spark, sf):
    return rounded(metrics.evaluate(views.scored(spark, sf), "actual", "prediction", ["client"]), 4)


_SEASON = "CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) <= 5 THEN 'spring' WHEN month(timestamp) <= 8 THEN 'summer' ELSE 'autumn' END"


@register(
    "metrics_by_slice",
    sql(" UNION ALL ".join(
        f"SELECT '{name}' AS slice, {expr} AS slice_value, {_metrics(digits=4)} FROM scored GROUP BY 2"
        for name, expr in (("season", _SEASON), ("hour", "hour(timestamp)::varchar"), ("is_weekend", "(isodow(timestamp) >= 6)::varchar"), ("meter", "slice"))
    )),
)
def metrics_by_slice(spark, sf):
    rows = views.scored(spark, sf).withColumnRenamed("slice", "meter")
    return rounded(metrics.evaluate_slices(rows, "actual", "prediction"), 4)


_BAND = "CASE WHEN {0} < -20 THEN 0 WHEN {0} >= 40 THEN 7 ELSE floor(({0} + 20) / 10) + 1 END::bigint"


@register(
    "metrics_by_temperature",
    sql(f"""SELECT {_BAND.format('air_temperature')} AS temperature_band, {_metrics('air_temperature', 'dew_temperature')} FROM weather_filled
  WHERE air_temperature IS NOT NULL AND dew_temperature IS NOT NULL GROUP BY 1"""),
)
def metrics_by_temperature(spark, sf):
    band = metrics.temperature_band(F.col("air_temperature")).alias("temperature_band")
    return rounded(metrics.evaluate(views.weather_filled(spark, sf), "air_temperature", "dew_temperature", [band]))


@register("building_r2", sql("SELECT building_id, " + ", ".join(
    r(f"CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum((actual - {p}) * (actual - {p})) / (var_pop(actual) * count(*)) END") + f" AS r2_{p}" for p in ("predicted_trees", "predicted_additive")
) + " FROM (SELECT client::varchar AS building_id, actual, prediction AS predicted_trees, prediction * 1.1::double AS predicted_additive FROM scored) GROUP BY 1"))
def building_r2(spark, sf):
    rows = views.scored(spark, sf).select(
        F.col("client").cast("string").alias("building_id"), "actual", F.col("prediction").alias("predicted_trees"),
        (F.col("prediction") * 1.1).alias("predicted_additive"),
    )
    path = scratch_path(spark, "scored")
    write_parquet(rows, path)
    return rounded(score_buildings(spark.read.parquet(path)))


@register("residual_histogram", sql("SELECT floor((actual - prediction) / 5000) * 5000::double AS residual_from, count(*) AS n FROM scored GROUP BY 1"))
def residual_histogram(spark, sf):
    return metrics.residual_histogram(views.scored(spark, sf), "actual", "prediction", 5000.0)


@register("log_safe_targets", sql("SELECT building_id, ord, " + r("ln(1 + CASE WHEN meter_reading < 0 THEN 0 ELSE meter_reading END)") + " AS log_reading FROM readings"))
def log_safe_targets(spark, sf):
    safe = F.log1p(at_least(F.col("meter_reading"), F.lit(0.0)))
    return rounded(views.readings(spark, sf).select("building_id", "ord", safe.alias("log_reading")))


@register("weekly_naive_forecast", sql(f"SELECT {_metrics('meter_reading', 'p')} FROM (SELECT meter_reading, {_lag(168)} AS p FROM grid) WHERE meter_reading IS NOT NULL AND p IS NOT NULL"))
def weekly_naive_forecast(spark, sf):
    """Same hour last week, scored on the hourly grid."""
    return rounded(metrics.evaluate(baselines.weekly_naive(_readings(spark, sf), align="time"), "meter_reading", "prediction"))


@register("rolling_mean_forecast", sql(f"SELECT {_metrics('meter_reading', 'p')} FROM (SELECT meter_reading, {_rolled('avg', 24)} AS p FROM kept) WHERE meter_reading IS NOT NULL AND p IS NOT NULL"))
def rolling_mean_forecast(spark, sf):
    return rounded(metrics.evaluate(baselines.rolling_mean(_readings(spark, sf)), "meter_reading", "prediction"))


@register(
    "target_encoded_use",
    views.CTE.rstrip() + ", " + _CUT.format("kept") + """SELECT m.building_id, """ + r("e.mean") + """ AS primary_use_target_mean FROM metadata_clean m
  LEFT JOIN (SELECT c.primary_use, avg(k.meter_reading) AS mean FROM kept k JOIN metadata_clean c USING (building_id), cut WHERE k.timestamp < t GROUP BY 1) e
  ON e.primary_use = m.primary_use""",
)
def target_encoded_use(spark, sf):
    """Mean reading per use over training rows only."""
    meta = views.metadata_clean(spark, sf).select("building_id", "primary_use")
    train, _ = splits.time_split(_readings(spark, sf))
    means = features.category_means(joins.attach_metadata(train, meta).filter("primary_use is not null"))
    return rounded(joins.lookup_join(meta, means, ["primary_use"]).select("building_id", "primary_use_target_mean"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "feature_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, " + r(f"corr({a}, {b})") + " AS correlation FROM lineitem"
        for a, b in combinations(_NUMBERS, 2)
    ),
)
def feature_correlation(spark, sf):
    """Input of a correlation heat map."""
    return rounded(correlation_matrix(views.table(spark, sf, "lineitem"), _NUMBERS))


# --- clients ---------------------------------------------------------------------------------------------------------


@register(
    "client_models",
    """SELECT l_suppkey::varchar AS client, count(*) AS n, """ + r("regr_intercept(l_extendedprice, l_quantity)", 3) + " AS intercept, "
    + r("regr_slope(l_extendedprice, l_quantity)", 4) + " AS slope FROM lineitem GROUP BY 1",
)
def client_models(spark, sf):
    """One least-squares model per client from distributed sums of products."""
    rows = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("client"), "l_quantity", "l_extendedprice")
    m = linear.fit_groups(rows, ["l_quantity"], "l_extendedprice", "client")
    coef = F.col("coefficients")
    return m.select(
        "client", "n", F.round(F.get(coef, F.lit(0)) + views.TIE, 3).alias("intercept"), F.round(F.get(coef, F.lit(1)) + views.TIE, 4).alias("slope")
    )


_LOCAL = """local AS (SELECT l_suppkey, count(*) AS n, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b
  FROM lineitem GROUP BY 1) """


@register("client_predictions", "WITH " + _LOCAL + "SELECT l_orderkey, l_linenumber, " + r("a + b * l_quantity", 3) + " AS prediction FROM lineitem JOIN local USING (l_suppkey)")
def client_predictions(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("client"), "l_quantity", "l_extendedprice")
    models = cut_lineage(linear.fit_groups(rows, ["l_quantity"], "l_extendedprice", "client"))
    out = linear.predict_groups(rows, models, ["l_quantity"], "client")
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 3)


@register("averaged_model", "WITH " + _LOCAL + "SELECT " + r("sum(n * a) / sum(n)", 3) + " AS intercept, " + r("sum(n * b) / sum(n)", 4) + " AS slope FROM local")
def averaged_model(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("client"), "l_quantity", "l_extendedprice")
    average = linear.average_models(linear.fit_groups(rows, ["l_quantity"], "l_extendedprice", "client"))
    coef = F.col("coefficients")
    return average.select(
        F.round(F.get(coef, F.lit(0)) + views.TIE, 3).alias("intercept"), F.round(F.get(coef, F.lit(1)) + views.TIE, 4).alias("slope")
    )


_DRAWN = """drawn AS (SELECT round, client FROM (SELECT c.client, g.round, row_number() OVER (PARTITION BY g.round
  ORDER BY md5(c.client || '|' || g.round || '|42')) AS r, count(*) OVER (PARTITION BY g.round) AS n
  FROM (SELECT DISTINCT l_suppkey::varchar AS client FROM lineitem) c, generate_series(1, {rounds}) g(round))
  WHERE r <= greatest(1, floor(n * {share}))) """


@register("sampled_clients", "WITH " + _DRAWN.format(rounds=5, share=0.5) + "SELECT round::int AS round, client FROM drawn")
def sampled_clients(spark, sf):
    clients = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("client"))
    return linear.sample_clients(clients, "client", 5, 0.5)


@register(
    "averaged_rounds",
    "WITH " + _LOCAL + ", " + _DRAWN.format(rounds=10, share=0.5) + "SELECT round::int AS round, count(*) AS clients, " + r("sum(n * a) / sum(n)", 3) + " AS intercept, "
    + r("sum(n * b) / sum(n)", 4) + " AS slope FROM drawn JOIN local ON l_suppkey::varchar = client GROUP BY 1",
)
def averaged_rounds(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("client"), "l_quantity", "l_extendedprice")
    out = linear.averaged_rounds(rows, ["l_quantity"], "l_extendedprice", "client", 10, 0.5, penalty=0.0)
    coef = F.col("coefficients")
    return out.select(
        "round", "clients", F.round(F.get(coef, F.lit(0)) + views.TIE, 3).alias("intercept"),
        F.round(F.get(coef, F.lit(1)) + views.TIE, 4).alias("slope"),
    )


@register(
    "client_round_scores",
    "WITH " + _CLIENT_SPLIT + """, local AS (SELECT client, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b
  FROM marked WHERE is_train GROUP BY 1),
score AS (SELECT client, sqrt(avg(pow(ln(1 + greatest(l_extendedprice, 0)) - ln(1 + greatest(a + b * l_quantity, 0)), 2))) AS rmsle
  FROM marked JOIN local USING (client) WHERE NOT is_train GROUP BY 1), """
    + _DRAWN.format(rounds=2, share=0.5)
    + "SELECT round::int AS round, count(*) AS clients, " + r("avg(rmsle)") + " AS avg_rmsle FROM drawn JOIN score ON score.client::varchar = drawn.client GROUP BY 1",
)
def client_round_scores(spark, sf):
    """Train on each client's first 80 %, score the rest, average the drawn clients per round."""
    rows = cut_lineage(_client_rows(spark, sf))
    models = cut_lineage(linear.fit_groups(rows.filter("is_train"), ["l_quantity"], "l_extendedprice", "client"))
    scored = linear.predict_groups(rows.filter("not is_train"), models, ["l_quantity"], "client")
    scores = metrics.evaluate(scored, "l_extendedprice", "prediction", ["client"])
    drawn = linear.sample_clients(models.select("client"), "client", 2, 0.5)
    return rounded(linear.round_summary(drawn, scores, "client"))


@register(
    "regime_comparison",
    "WITH " + _CLIENT_SPLIT + """, local AS (SELECT client, count(*) AS n, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b
  FROM marked WHERE is_train GROUP BY 1),
pool AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS pa, regr_slope(l_extendedprice, l_quantity) AS pb FROM marked WHERE is_train),
mean AS (SELECT sum(n * a) / sum(n) AS fa, sum(n * b) / sum(n) AS fb FROM local),
tall AS (SELECT 'per_site' AS regime, l_extendedprice AS y, a + b * l_quantity AS p FROM marked JOIN local USING (client) WHERE NOT is_train
  UNION ALL SELECT 'centralized', l_extendedprice, pa + pb * l_quantity FROM marked, pool WHERE NOT is_train
  UNION ALL SELECT 'federated', l_extendedprice, fa + fb * l_quantity FROM marked, mean WHERE NOT is_train) """
    + f"SELECT regime, {_metrics('y', 'p', 3)} FROM tall GROUP BY 1",
)
def regime_comparison(spark, sf):
    rows = cut_lineage(_client_rows(spark, sf))
    return rounded(regimes.compare_regimes(rows.filter("is_train"), rows.filter("not is_train"), ["l_quantity"], "l_extendedprice", "client", 0.0), 3)


@register(
    "ridge_over_folds",
    _ROLLING_FOLDS + """, s AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, l_quantity AS x, l_extendedprice AS y FROM lineitem),
fit AS (SELECT fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy
  FROM s JOIN folds ON m BETWEEN train_from AND train_to GROUP BY 1),
alphas AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0])::double AS alpha),
model AS (SELECT fold, alpha, n, sxy / (sxx + alpha) AS b, my - sxy / (sxx + alpha) * mx AS a FROM fit, alphas)
SELECT f.fold, alpha, any_value(n) AS train_rows, count(*) AS test_rows, """ + r("sqrt(avg(pow(y - a - b * x, 2)))", 3)
    + " AS rmse FROM s JOIN folds f ON m BETWEEN test_from AND test_to JOIN model USING (fold) GROUP BY 1, 2",
)
def ridge_over_folds(spark, sf):
    """The whole grid of penalties over rolling folds from one pass of monthly sums."""
    rows = views.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("timestamp"), "l_quantity", "l_extendedprice")
    folds = splits.time_folds(views.scored(spark, sf))
    return rounded(linear.tune_ridge(rows, ["l_quantity"], "l_extendedprice", folds), 3)


@register(
    "day_effects",
    """WITH m AS (SELECT l_linestatus AS client, day(l_shipdate) AS day, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2)
SELECT client, m.day::int AS day, """ + r("m.m - base.m", 3) + " AS effect FROM m JOIN m base USING (client) WHERE base.day = 1 AND m.day > 1",
)
def day_effects(spark, sf):
    """Thirty 0/1 columns in one model per client: a day's slope is the distance of its mean from the first day's."""
    days = list(range(2, 32))
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("client"), "l_extendedprice", *[(F.dayofmonth("l_shipdate") == d).cast("double").alias(f"day_{d}") for d in days]
    )
    models = linear.fit_groups(rows, [f"day_{d}" for d in days], "l_extendedprice", "client")
    slopes = models.select("client", F.posexplode(F.slice("coefficients", 2, len(days))).alias("at", "effect"))
    return rounded(slopes.select("client", (F.col("at") + 2).alias("day"), "effect"), 3)


# --- trained models --------------------------------------------------------------------------------------------------

_TREE_FEATURES = ["l_quantity", "l_discount", "l_tax", "month", "dayofweek"]


def _model_rows(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"), F.col("l_suppkey").cast("string").alias("building_id"), "l_orderkey", "l_linenumber",
        "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("meter_reading"),
    )
    return splits.time_split(add_calendar_features(rows))


@register("boosted_tree_metrics")
def boosted_tree_metrics(spark, sf):
    """Trees with early stopping on the newest training hours; saved, loaded, and scored on the test rows."""
    train, test = _model_rows(spark, sf)
    model = boosted.fit_boosted(train, _TREE_FEATURES)
    path = scratch_path(spark, "trees")
    boosted.save_model(model, path)
    scored = boosted.predict_boosted(boosted.load_model(path), test, _TREE_FEATURES)
    return metrics.evaluate(scored, "meter_reading", "prediction")


@register("tree_importances")
def tree_importances(spark, sf):
    train, _ = _model_rows(spark, sf)
    return boosted.importances(boosted.fit_boosted(train, _TREE_FEATURES), spark)


@register("tree_grid_over_folds")
def tree_grid_over_folds(spark, sf):
    train, _ = _model_rows(spark, sf)
    folds = splits.time_folds(train, n_splits=2)
    return boosted.tune_boosted(train, _TREE_FEATURES[:3], folds, [{"maxIter": 2, "maxDepth": d} for d in (2, 4)])


@register("additive_grid_over_folds")
def additive_grid_over_folds(spark, sf):
    train, _ = _model_rows(spark, sf)
    folds = splits.time_folds(train, n_splits=2)
    grid = [{"bins": b, "interactions": i} for b, i in ((8, 0), (16, 2))]
    return tune_additive(train, _TREE_FEATURES[:3], folds, grid)


def _additive(spark, sf) -> tuple[AdditiveModel, object]:
    train, test = _model_rows(spark, sf)
    model = fit_additive(train, _TREE_FEATURES, bins=16, interactions=3)
    return model, test


@register("additive_metrics")
def additive_metrics(spark, sf):
    model, test = _additive(spark, sf)
    path = scratch_path(spark, "additive")
    model.save(spark, path)
    return metrics.evaluate(AdditiveModel.load(spark, path).predict(test), "meter_reading", "prediction")


@register(
    "additive_one_feature",
    """WITH v AS (SELECT l_discount, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
t AS (SELECT *, 0.001::double * sum(n) OVER () AS k FROM v),
c AS (SELECT sum(n * k / (n + k) * m) / sum(n * k / (n + k)) AS mu FROM t)
SELECT l_discount, """ + r("mu + n * (m - mu) / (n + k)", 3) + " AS prediction FROM t, c",
)
def additive_one_feature(spark, sf):
    """With one feature of few values, the ridge fit of its bins has a closed form."""
    rows = views.table(spark, sf, "lineitem").select("l_discount", F.col("l_extendedprice").alias("meter_reading"))
    model = fit_additive(rows, ["l_discount"], bins=64, interactions=0, penalty=1e-3)
    return rounded(model.predict(rows.select("l_discount").distinct()), 3)


@register(
    "boosted_stump",
    """WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS code, count(*) AS n, sum(l_extendedprice) AS t
  FROM lineitem GROUP BY 1),
side AS (SELECT cut, code <= cut AS low, sum(n) AS n, sum(t) AS t FROM s, (SELECT unnest([0, 1]) AS cut) GROUP BY 1, 2),
best AS (SELECT arg_max(cut, gain) AS cut FROM (SELECT cut, sum(t * t / n) AS gain FROM side GROUP BY 1))
SELECT s.code::int AS code, """ + r("side.t / side.n", 3) + """ AS prediction FROM s, best JOIN side ON side.cut = best.cut
WHERE side.low = (s.code <= best.cut)""",
)
def boosted_stump(spark, sf):
    """One tree of depth one on a three-valued feature: the better cut and its two leaf means."""
    flag = F.col("l_returnflag")
    code = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    rows = views.table(spark, sf, "lineitem").select(code.alias("code"), F.col("l_extendedprice").alias("meter_reading"))
    model = boosted.fit_boosted(
        rows, ["code"], validation_share=None, maxIter=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all"
    )
    return rounded(boosted.predict_boosted(model, rows.select("code").distinct(), ["code"]), 3)


def _stump_stages(last: int) -> str:
    """Stumps on two features of three values each, by their nine cells: best cut, leaf means, and the held-out error of each stage."""
    out = """WITH cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT l_shipdate AS t FROM lineitem)) WHERE rn = floor(0.9 * n) + 1),
s AS (SELECT l_linenumber % 3 AS line, floor(l_quantity / 17) AS size, l_extendedprice AS y, l_shipdate >= t AS held FROM lineitem, cut),
p0 AS (SELECT line, size, count(*) FILTER (NOT held) AS n, coalesce(sum(y) FILTER (NOT held), 0) AS t, count(*) FILTER (held) AS hn,
  coalesce(sum(y) FILTER (held), 0) AS ht, coalesce(sum(y * y) FILTER (held), 0) AS hq, 0.0::double AS p FROM s GROUP BY 1, 2)"""
    for i in range(1, last + 1):
        out += f""",
o{i} AS (SELECT feature, pos, sum(n) AS n, sum(n) FILTER (low) AS nl, sum(r) FILTER (low) AS rl, sum(n) FILTER (NOT low) AS nr, sum(r) FILTER (NOT low) AS rr
  FROM (SELECT feature, pos, n, t - n * p AS r, CASE feature WHEN 'line' THEN line ELSE size END <= pos AS low
        FROM p{i - 1}, (SELECT unnest(['line', 'size']) AS feature), (SELECT unnest([0, 1]) AS pos)) GROUP BY 1, 2),
b{i} AS (SELECT *, rl * rl / nl + rr * rr / nr - (rl + rr) * (rl + rr) / n AS gain FROM o{i} ORDER BY gain DESC, feature, pos LIMIT 1),
p{i} AS (SELECT line, size, c.n, t, hn, ht, hq,
  p + CASE WHEN CASE feature WHEN 'line' THEN line ELSE size END <= pos THEN rl / nl ELSE rr / nr END AS p FROM p{i - 1} c, b{i})"""
    return out


_STAGES = 4


def _stumps(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"), (F.col("l_linenumber") % 3).alias("line"), F.floor(F.col("l_quantity") / 17).alias("size"),
        F.col("l_extendedprice").alias("meter_reading"),
    )
    train, held = splits.time_split(rows, 0.9)
    model = boosted.fit_boosted(
        train, ["line", "size"], validation_share=None, maxIter=_STAGES, maxDepth=1, stepSize=0.5, subsamplingRate=1.0, featureSubsetStrategy="all"
    )
    return model, held


@register(
    "boosted_stages",
    _stump_stages(_STAGES) + ", e AS (" + " UNION ALL ".join(
        f"SELECT {i} AS stage, sum(hq - 2 * p * ht + hn * p * p) / sum(hn) AS mse FROM p{i}" for i in range(1, _STAGES + 1)
    ) + """) SELECT stage::int AS stage, """ + r("sqrt(mse)", 3) + " AS rmse, stage <= (SELECT arg_min(stage, mse) FROM e) AS kept FROM e",
)
def boosted_stages(spark, sf):
    """Held-out error after each of four stumps, and the stages that stay."""
    model, held = _stumps(spark, sf)
    errors = boosted.stage_errors(model, held)
    best = boosted.best_stage(errors)
    found = [(i, float(e), i <= best) for i, e in enumerate(errors, 1)]
    return rounded(spark.createDataFrame(found, "stage int, mse double, kept boolean").select("stage", F.sqrt("mse").alias("rmse"), "kept"), 3)


@register(
    "boosted_gains",
    _stump_stages(_STAGES) + ", g AS (" + " UNION ALL ".join(f"SELECT feature, gain FROM b{i}" for i in range(1, _STAGES + 1))
    + ") SELECT f.feature, " + r("coalesce(sum(gain), 0) / 1e6", 2) + """ AS importance, count(gain) AS splits
FROM (SELECT unnest(['line', 'size']) AS feature) f LEFT JOIN g USING (feature) GROUP BY 1""",
)
def boosted_gains(spark, sf):
    """Gain by feature of the same stumps, in millions of squared error."""
    model, _ = _stumps(spark, sf)
    found = boosted.importances(model, spark)
    return rounded(found.select("feature", (F.col("importance") / 1e6).alias("importance"), "splits"), 2)


@register("additive_importances")
def additive_importances(spark, sf):
    return _additive(spark, sf)[0].explain_global(spark)


@register("additive_shapes")
def additive_shapes(spark, sf):
    return _additive(spark, sf)[0].shape_table(spark)


@register("additive_contributions")
def additive_contributions(spark, sf):
    model, test = _additive(spark, sf)
    return model.explain_local(test, ["l_orderkey", "l_linenumber"])


@register("scored_models")
def scored_models(spark, sf):
    """Actual, both predictions, time and building of the test rows."""
    train, test = _model_rows(spark, sf)
    trees = boosted.fit_boosted(train, _TREE_FEATURES)
    additive = fit_additive(train, _TREE_FEATURES, bins=16, interactions=2)
    scored = boosted.predict_boosted(trees, test, _TREE_FEATURES, "predicted_trees")
    return additive.predict(scored, "predicted_additive").withColumnRenamed("meter_reading", "actual").select(
        "building_id", "timestamp", "actual", "predicted_trees", "predicted_additive", *_TREE_FEATURES
    )


@register("site_round_scores")
def site_round_scores(spark, sf):
    """The per-site training rounds on the feature table."""
    rows = features.drop_warm_up(windows.add_temporal_features(_readings(spark, sf), lags=(1, 24), rolling=((24, ("mean",)),)))
    rows = joins.attach_metadata(rows, views.metadata(spark, sf).select("building_id", "site_id"))
    names = ["meter_reading_lag_1h", "meter_reading_lag_24h", "meter_reading_rolling_24h_mean"]
    return client_round_metrics(rows, names)
