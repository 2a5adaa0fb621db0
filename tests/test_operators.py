"""Small hand-computed cases per operator."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meterlake.functions.calendar import add_calendar_features, add_profile_calendar, is_us_holiday, season
from meterlake.functions.columns import clip, nan_to_null, pearson
from meterlake.functions.physical import area_per_floor, building_age, parse_building_id, relative_humidity, tidy_category
from meterlake.models.linear import average_models
from meterlake.models.metrics import evaluate
from meterlake.operators import cleaning, features, joins, reshape, splits, windows
from meterlake.reports import meter, quality, temporal
from meterlake.schemas import MissingColumns, has_columns, numeric_columns

T0 = datetime(2024, 1, 1)


def hourly(spark, groups, step=timedelta(hours=1)):
    """Readings per building, one per hour."""
    rows = [(b, T0 + i * step, None if v is None else float(v)) for b, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "building_id string, timestamp timestamp_ntz, meter_reading double")


def values(df, column="meter_reading", order=("building_id", "timestamp")):
    return [row[0] for row in df.orderBy(*order).select(column).collect()]


# Published hourly and monthly means; their summary figures are checked below.
HOURLY_MEANS = [
    80.9151426709738,
    79.53165482994511,
    78.42484922518094,
    77.48003817582479,
    77.04193645867814,
    78.20861115585652,
    82.87740741731719,
    88.64195272042699,
    90.1604922268502,
    92.03820742962748,
    93.7491554317395,
    95.04627192387257,
    96.54171168512363,
    97.05121302836811,
    97.0359152296235,
    96.77916021321491,
    96.11595197214177,
    94.82951005502613,
    94.976945559984,
    94.86506013981183,
    94.49513174434199,
    93.57449147380063,
    90.37011382809584,
    83.95347021470738,
]
MONTHLY_MEANS = [
    56.65367949322931,
    55.59640064799439,
    55.60465001255727,
    55.4637808857417,
    71.6354966867429,
    107.71148606104099,
    111.40792756359679,
    112.01415792451552,
    113.17054262462135,
    112.84410377647791,
    112.8699676396497,
    105.5752960519523,
]

TWO = {"1": [10, 20, 30], "2": [1, 2, 3]}


@pytest.mark.parametrize("split", [False, True])
def test_gap_fill_both(spark, split):
    gaps = [None, None, None, 1, None, None, None, None, None, 2, None, None, None]
    out = windows.fill_gaps(hourly(spark, {"1": gaps}), ["meter_reading"], ["building_id"], 2, "both", split=split, limit=3)
    assert values(out) == [None, 1, 1, 1, 1, 1, None, 2, 2, 2, 2, 2, None]


def test_gap_fill_method_is_checked(spark):
    with pytest.raises(ValueError):
        windows.fill_gaps(hourly(spark, TWO), ["meter_reading"], ["building_id"], method="sideways")


def test_lag(spark):
    out = windows.add_lag_features(hourly(spark, TWO), hours=(1,))
    assert values(out, "meter_reading_lag_1h") == [None, 10, 20, None, 1, 2]


def test_rolling_does_not_cross_buildings(spark):
    out = windows.add_rolling_features(hourly(spark, TWO), windows=((2, ("mean", "std", "median")),))
    assert values(out, "meter_reading_rolling_2h_mean") == [None, 10, 15, None, 1, 1.5]
    std = values(out, "meter_reading_rolling_2h_std")
    assert std[:2] == [None, None] and std[2] == pytest.approx(7.0710678) and std[5] == pytest.approx(0.7071068)
    assert "meter_reading_rolling_2h_median" not in out.columns


def test_expanding_and_difference(spark):
    df = hourly(spark, TWO)
    assert values(windows.add_expanding_features(df, functions=("mean",)), "meter_reading_expanding_mean") == [None, 10, 15, None, 1, 1.5]
    assert values(windows.add_diff_features(df, hours=(1,)), "meter_reading_diff_1h") == [None, 10, 10, None, 1, 1]


def test_time_alignment_counts_hours(spark):
    df = hourly(spark, {"1": [1, 2, 3]}).filter(F.hour("timestamp") != 1)
    out = windows.add_lag_features(df, hours=(1,), align="time")
    assert values(out) == [1, None, 3] and values(out, "meter_reading_lag_1h") == [None, 1, None]


def test_negative_handling(spark):
    df = hourly(spark, {"1": [-1, None, 2]})
    assert values(cleaning.keep_non_negative(df)) == [None, 2]
    assert values(cleaning.handle_negatives(df, "remove", drop_nulls=True)) == [2]
    assert values(cleaning.handle_negatives(df, "clip")) == [0, None, 2]


def test_first_duplicate_wins(spark):
    df = spark.createDataFrame(
        [("a", T0, 2, 7.0), ("a", T0, 1, 5.0), ("b", T0, 3, 1.0)],
        "building_id string, timestamp timestamp_ntz, ord bigint, meter_reading double",
    )
    assert values(cleaning.drop_duplicates(df)) == [5.0, 1.0]


def test_duplicate_removal_prunes_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("string(id % 3) building_id", "timestamp_ntz'2024-01-01' timestamp", "id ord", "1.0D meter_reading")
    plan = cleaning.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.rindex("Partial")


def test_date_range_end(spark):
    df = hourly(spark, {"1": [1, 2, 3]})
    assert values(cleaning.in_date_range(df, "2023-12-01", "2024-01-01")) == [1]
    assert values(cleaning.in_date_range(df, "2023-12-01", "2024-01-01", end_inclusive_day=True)) == [1, 2, 3]


def test_meter_type_filter(spark):
    df = hourly(spark, {"1": [1, 2]}).withColumn("meter", F.hour("timestamp"))
    assert cleaning.of_meter_type(df, "chilledwater").count() == 1
    assert cleaning.of_meter_type(df, "all").count() == cleaning.of_meter_type(df, "plasma").count() == 2


@pytest.mark.parametrize("split", [False, True])
def test_outlier_bounds_and_actions(spark, split):
    df = hourly(spark, {"1": [1, 2, 3, 4, 100, None]})
    options = {"split": split, "limit": 2}
    assert cleaning.outlier_bounds(df, **options).first().asDict() == {"lower_bound": -4.0, "upper_bound": 10.0}
    assert values(cleaning.handle_outliers(df, **options)) == [1, 2, 3, 4, 10, None]
    assert values(cleaning.handle_outliers(df, action="remove", **options)) == [1, 2, 3, 4]
    assert values(cleaning.handle_outliers(df, action="flag", **options), "is_outlier") == [False] * 4 + [True, False]


def test_building_exclusion(spark):
    df = hourly(spark, {"full": [1, 2, 0, 4], "empty": [None, None, None, 1], "idle": [0, 0, 0, None]})
    def kept(out):
        return {r[0] for r in out.select("building_id").distinct().collect()}

    assert kept(cleaning.drop_high_missing(df, 0.7)) == {"full", "idle"}
    assert kept(cleaning.drop_high_zero(df, 0.7)) == {"full", "empty"}
    assert kept(cleaning.drop_sparse(df, 0.7)) == {"full", "idle"}


def test_cleaning_counts_and_observation(spark):
    from pyspark.sql import Observation

    df = hourly(spark, {"1": [-1, 0, None, 2]}).unionByName(hourly(spark, {"1": [5, 6]}))
    row = cleaning.cleaning_counts(df).first().asDict()
    assert row["initial_rows"] == 6 and row["negatives"] == 1 and row["zeros"] == 1 and row["missing"] == 1
    assert row["duplicates"] == 1 and row["final_rows"] == 4 and row["removed_pct"] == pytest.approx(100 / 3)
    seen = Observation("clean")
    assert cleaning.clean_readings(df, observation=seen).count() == 4
    assert seen.get == {"initial_rows": 6, "negatives": 1, "zeros": 1, "missing": 1}


def test_sample_moments(spark):
    df = hourly(spark, {"1": [1, 2, 3, 4, 100]}).withColumn("meter", F.lit("m"))
    row = meter.meter_distributions(df).first()
    assert row["skewness"] == pytest.approx(2.2323959116) and row["kurtosis"] == pytest.approx(4.9868659572)
    std = meter.compare_meters(df).first()["std"]
    assert std == pytest.approx(39.012818406)
    flat = hourly(spark, {"1": [1, 1]}).withColumn("meter", F.lit("m"))
    assert meter.meter_distributions(flat).first()["skewness"] is None


@pytest.mark.parametrize("method", ["statistical", "bounds"])
def test_anomalies(spark, method):
    day = timedelta(days=1)
    flagged = temporal.detect_anomalies(hourly(spark, {"1": [1] * 19 + [50]}, day), method).filter("is_anomaly")
    assert values(flagged) == [50]
    assert temporal.detect_anomalies(hourly(spark, {"1": [1] * 9 + [50]}, day), method).filter("is_anomaly").count() == 0


def test_published_profile_identities(spark):
    df = hourly(spark, {"1": HOURLY_MEANS})
    row = temporal.hourly_summary(df).first()
    assert (row["peak_hour"], row["low_hour"]) == (13, 4)
    assert row["hourly_variance"] == pytest.approx(7.351883817758644, rel=1e-12)
    months = [("1", datetime(2016, i, 1), v) for i, v in enumerate(MONTHLY_MEANS, 1)]
    df = spark.createDataFrame(months, "building_id string, timestamp timestamp_ntz, meter_reading double")
    row = temporal.seasonal_summary(df).first()
    assert (row["peak_month"], row["low_month"]) == (9, 4)
    assert row["seasonal_variance"] == pytest.approx(27.10611481390587, rel=1e-12)


def test_peak_ties_take_the_smallest_hour(spark):
    row = temporal.hourly_summary(hourly(spark, {"1": [1, 5, 5, 1]})).first()
    assert (row["peak_hour"], row["low_hour"]) == (1, 0)


def test_time_split_reaches_the_scan(spark, tmp_path):
    hourly(spark, {"1": range(100)}).write.parquet(str(tmp_path / "t"))
    train, test = splits.time_split(spark.read.parquet(str(tmp_path / "t")))
    assert (train.count(), test.count()) == (80, 20)
    assert "LessThan(timestamp,2024-01-04T08:00)" in train._jdf.queryExecution().executedPlan().toString()
    empty = splits.time_split(hourly(spark, {"1": range(3)}).limit(0))
    assert [part.count() for part in empty] == [0, 0]


def test_time_split_within_a_minute(spark):
    micro = timedelta(microseconds=10)
    assert splits.split_time(hourly(spark, {"1": range(1000)}, micro)).first()[0] == T0 + 800 * micro


@pytest.mark.parametrize("n", [10, 11])
def test_time_split_position(spark, n):
    df = hourly(spark, {"1": range(n)})
    assert splits.split_time(df).first()[0] == T0 + timedelta(hours=8)
    train, test = splits.time_split(df)
    assert (train.count(), test.count()) == (8, n - 8)


def test_client_split(spark):
    out = splits.mark_client_split(hourly(spark, {"a": range(10), "b": range(4)}), "building_id", ["timestamp"])
    assert values(out, "is_train") == [True] * 8 + [False] * 2 + [True] * 3 + [False]


def test_seeded_sample_is_stable(spark):
    df = hourly(spark, {"a": range(50)})
    first = values(splits.seeded_sample(df, ["timestamp"], 10))
    assert len(first) == 10 and first == values(splits.seeded_sample(df.repartition(7), ["timestamp"], 10))
    assert splits.seeded_sample(df, ["timestamp"], 1000).count() == 50
    large = spark.range(20_000)
    bounded = splits.seeded_sample(large, ["id"], 20)
    plain = large.orderBy(splits.seeded_key(["id"], 42), "id").limit(20)
    assert "__key" not in bounded.columns and bounded.collect() == plain.collect()


def test_calendar(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=6),), (datetime(2021, 1, 3),)], "timestamp timestamp_ntz")
    row = add_calendar_features(df).orderBy("timestamp").collect()[1]
    assert row["dayofweek"] == 0 and row["is_weekend"] == 0
    assert row["hour_sin"] == pytest.approx(1.0) and row["hour_cos"] == pytest.approx(0.0, abs=1e-15)
    row = add_profile_calendar(df).orderBy("timestamp").collect()[0]
    assert row["week_of_year"] == 53 and row["is_weekend"] and not row["is_month_start"] and not row["is_month_end"]


def test_holidays_and_seasons(spark):
    # The federal holidays of 2024.
    expected = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02",
                "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25"]
    days = spark.range(366).select(F.expr("cast(date'2024-01-01' + cast(id as int) as timestamp_ntz)").alias("t"))
    found = days.filter(is_us_holiday(F.col("t"))).select(F.to_date("t").cast("string")).collect()
    assert sorted(r[0] for r in found) == expected
    seasons = spark.range(1, 13).select(season(F.col("id"))).collect()
    assert [r[0] for r in seasons] == ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["autumn"] * 3 + ["winter"]


def test_humidity(spark):
    df = spark.createDataFrame([(20.0, 10.0), (20.0, 25.0), (20.0, None)], "t double, d double")
    found = [r[0] for r in df.select(relative_humidity(F.col("t"), F.col("d"))).collect()]
    assert found[0] == pytest.approx(52.5413255811) and found[1:] == [100.0, None]


def test_building_functions(spark):
    df = spark.createDataFrame([("S1_office_B_2", " A b\t", 2030), ("B29", None, 1990)], "id string, use string, built int")
    rows = df.select(tidy_category(F.col("use")).alias("use"), building_age(F.col("built"), 2025).alias("age"),
                     *[c.alias(n) for n, c in parse_building_id(F.col("id")).items()]).collect()
    assert tuple(rows[0]) == ("a b", 0, "S1", "office", "B_2") and tuple(rows[1]) == (None, 35, "unknown", "unknown", "B29")
    area = spark.createDataFrame([(100.0, None), (100.0, 4.0), (100.0, 0.0)], "s double, f double")
    assert [r[0] for r in area.select(area_per_floor(F.col("s"), F.col("f"))).collect()] == [100, 25, None]


def test_null_and_nan_helpers(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (5.0,)], "x double")
    assert [r[0] for r in nan_to_null(df).collect()] == [None, None, 5.0]
    assert [r[0] for r in nan_to_null(df).select(clip(F.col("x"), F.lit(0.0), F.lit(3.0))).collect()] == [None, None, 3.0]
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 9.0)], "a double, b double")
    assert pairs.agg(pearson(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1.0)
    assert pairs.agg(pearson(F.lit(1.0), F.col("b"))).first()[0] is None


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, -1.0), (10.0, 12.0), (20.0, 18.0), (30.0, 33.0)], "a double, p double")
    row = evaluate(df, "a", "p").first()
    assert row["rmse"] == pytest.approx(2.1213203436) and row["mae"] == 2.0 and row["r2"] == pytest.approx(0.964)
    assert row["rmsle"] == pytest.approx(0.1077689614) and row["mape"] == pytest.approx(13.3333333333)
    single = evaluate(df.limit(1), "a", "p").first()
    assert single["r2"] is None and single["mape"] is None


def test_continuity(spark):
    times = [T0, T0 + timedelta(hours=1), T0 + timedelta(minutes=90), T0 + timedelta(hours=3)]
    df = spark.createDataFrame([(t,) for t in times] * 2, "timestamp timestamp_ntz")
    row = quality.continuity(df).first()
    assert tuple(row) == (4, 4, 1, 1, 100.0)
    assert [r[0] for r in quality.missing_timestamps(df).collect()] == [T0 + timedelta(hours=2)]
    assert [r[0] for r in quality.extra_timestamps(df).collect()] == [times[2]]
    assert quality.continuity(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_gap_intervals(spark, split):
    def at(*minutes):
        return [T0 + timedelta(minutes=m) for m in minutes]

    times = {"a": at(0, 60, 60, 300, 330, 480), "b": at(0, 60), "c": at(30), None: at(0, 180), "d": [None]}
    df = spark.createDataFrame([(b, t) for b, ts in times.items() for t in ts], "building_id string, timestamp timestamp_ntz")
    gaps = windows.gap_intervals(df, split=split, limit=2)
    assert sorted(map(tuple, gaps.collect()), key=str) == sorted(
        [("a", *at(120, 240), 3), ("a", *at(390, 450), 2), (None, *at(60, 120), 2)], key=str
    )
    assert tuple(quality.gap_summary(df, split=split, limit=2).filter("building_id = 'a'").first()) == ("a", 2, 5, 3, *at(120))
    spelled = quality.missing_times_by_group(df, split=split, limit=2)
    assert sorted(r[1] for r in spelled.filter("building_id = 'a'").collect()) == at(120, 180, 240, 390, 450)
    assert windows.gap_intervals(df.limit(0), split=False).count() == 0


def test_a_long_gap_is_one_row(spark):
    df = spark.createDataFrame([("a", datetime(1900, 1, 1)), ("a", datetime(2400, 1, 1))], "building_id string, timestamp timestamp_ntz")
    assert windows.gap_intervals(df, step="1 minute").collect()[0][3] == (datetime(2400, 1, 1) - datetime(1900, 1, 1)) // timedelta(minutes=1) - 1


def test_meter_pairs_in_one_shuffle(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice(["a", "b", None]), rng.randrange(4), rng.choice(["w", "x", "y", None]), rng.choice([1.0, 2.5, None]), i, "z")
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "building_id string, timestamp int, meter string, meter_reading double, ord int, meter_1 string")
    first = {}
    for b, t, m, v, _, _ in rows:
        if None not in (b, t, m):
            first.setdefault((b, t, m), v)
    want = [(b, t, m, v, n, first[b, t, n]) for (b, t, m), v in first.items() for n in "wxy" if m < n and (b, t, n) in first]
    out = joins.meter_pairs(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) > 10
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {(r[2], r[4]) for r in joins.meter_pairs(df, ["w", "y"]).collect()} == {("w", "y")}
    assert joins.meter_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        joins.meter_pairs(df, max_types=2)


def test_weighted_average(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 3, [5.0, 4.0])], "client string, n bigint, coefficients array<double>")
    assert average_models(df).first()[0] == [4.0, 3.0]
    assert average_models(df, weighted=False).first()[0] == [3.0, 2.0]


def test_wide_layout(spark):
    wide = spark.createDataFrame([("2024-01-01 00:00:00", *map(float, range(11))), ("2024-01-01 01:00:00", *[None] * 11)],
                                 "t string, " + ", ".join(f"`b.{i}` double" for i in range(11)))
    long = reshape.normalise_readings(wide)
    assert long.columns == ["timestamp", "building_id", "meter_reading"] and long.count() == 22
    assert long.filter("building_id = 'b.3' and meter_reading = 3.0").count() == 1
    assert long.filter("meter_reading is null").count() == 11
    no_time = wide.withColumn("t", F.lit("x"))
    with pytest.raises(ValueError):
        reshape.normalise_readings(no_time)
    with pytest.raises(ValueError):
        reshape.resolve_reading(wide)
    assert reshape.first_buildings(["a", "b", "c"], 2) == ["a", "b"]


def test_bad_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01",), ("soon",), (None,)], "timestamp string")
    assert reshape.bad_timestamps(df).first()[0] == 1
    assert reshape.parse_timestamps(df, errors="null").filter("timestamp is null").count() == 2
    with pytest.raises(PySparkException):
        reshape.parse_timestamps(df).collect()


def test_categories_and_features(spark):
    df = spark.createDataFrame([(v, 1.0, None) for v in "aaabbcd"] + [(None, 1.0, 2.0)], "primary_use string, square_feet double, floor_count double")
    top = features.top_categories(df, "primary_use", 2)
    out = features.add_building_features(df, top)
    counts = {r[0]: r[1] for r in out.groupBy("primary_use_grouped").count().collect()}
    assert counts == {"a": 3, "b": 2, "other": 3}
    assert out.agg(F.sum("use_other")).first()[0] == 3
    assert features.feature_columns(out) == ["square_feet", "floor_count", "use_a", "use_b", "use_other", "sqft_per_floor"]
    assert features.project(out, ["square_feet", "square_feet"]).columns == ["square_feet"]


def test_warm_up_columns_are_exact():
    names = ["meter_reading_lag_1h", "flag", "my_rolling_x", "air_temperature_rolling_24h", "meter_reading_rolling_24h_mean"]
    assert features.warm_up_columns(names) == [names[0], names[3], names[4]]


def test_strict_columns(spark):
    df = spark.createDataFrame([(1, True, "x")], "a int, b boolean, c string")
    assert numeric_columns(df) == ["a", "b"]
    assert not has_columns(df, ["z"], strict=False)
    with pytest.raises(MissingColumns):
        features.add_weather_features(df)
    assert features.add_weather_features(df, strict=False).columns == df.columns


def test_folds(spark):
    df = spark.createDataFrame([(datetime(2024, m, 1),) for m in range(1, 13)], "timestamp timestamp_ntz")
    rolling = {r["fold"]: r for r in splits.time_folds(df, 5).collect()}
    base = 2024 * 12
    assert (rolling[1]["train_from"], rolling[1]["train_to"], rolling[1]["test_from"], rolling[1]["test_to"]) == (base, base + 6, base + 7, base + 7)
    assert rolling[5]["train_from"] == base + 4 and rolling[5]["test_to"] == base + 11
    growing = splits.assign_folds(df, splits.time_folds(df, 5, method="expanding")).groupBy("fold", "role").count().collect()
    assert {(r[0], r[1]): r[2] for r in growing}[(5, "train")] == 11
