"""File order, partition values, pushed filters and size-checked joins: behaviour that no registered query shows."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from meterlake.operators import cleaning
from meterlake.operators.skew import lookup_join
from meterlake.plans.preparation import prepare
from meterlake.sources import files

ROW = "building_id string, timestamp timestamp_ntz, meter int, meter_reading double, site_id string"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_first_file_wins_over_a_larger_later_one(spark, tmp_path):
    low = spark.sql("select 'b' as building_id, timestamp_ntz'2016-01-01' as timestamp, 1.0D as meter_reading")
    many = spark.range(20_000).selectExpr("concat('x', id) as building_id", "timestamp_ntz'2016-01-01' as timestamp", "3.0D as meter_reading")
    high = spark.sql("select 'b' as building_id, timestamp_ntz'2016-01-01' as timestamp, 2.0D as meter_reading")
    low.coalesce(1).write.parquet(f"{tmp_path}/t/f=1")
    high.unionByName(many).coalesce(1).write.parquet(f"{tmp_path}/t/f=2")
    kept = cleaning.clean_readings(spark.read.parquet(f"{tmp_path}/t").drop("f"))
    assert kept.where("building_id = 'b'").first().meter_reading == 1.0 and kept.count() == 20_001


def test_site_ids_keep_their_zeros(spark, tmp_path):
    rows = spark.sql("select 'b' as building_id, timestamp_ntz'2016-01-01' as timestamp, 1.0D as meter_reading, explode(array('007', '012')) as site_id")
    files.write_readings(rows, f"{tmp_path}/r")
    back = files.read_parquet(spark, f"{tmp_path}/r")
    assert dict(back.dtypes)["site_id"] == "string" and {r.site_id for r in back.collect()} == {"007", "012"}
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"


def test_shuffled_lookup_of_keys_only(spark):
    left = spark.range(100).select((F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = lookup_join(left, right, ["k"], broadcast_rows=1, limit=10).collect()
    assert sorted((r.k, r.v) for r in got if r.k < 5) == sorted((i % 7, i % 7 * 10) for i in range(100) if i % 7 < 5) and len(got) == 100


def test_prepare_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], ROW).drop("site_id").write.parquet(f"{tmp_path}/m")
    metadata = spark.createDataFrame([], "building_id string, site_id string, primary_use string, square_feet double, year_built int, floor_count double")
    weather = spark.createDataFrame([], "site_id string, timestamp timestamp_ntz, air_temperature double, dew_temperature double")
    text = plan_of(prepare(spark.read.parquet(f"{tmp_path}/m"), metadata, weather, 2025, split=False, strict=False))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line and "timestamp" in line)
    assert "GreaterThanOrEqual(timestamp" in pushed and "EqualTo(meter" in pushed


def test_excluded_list_does_not_shuffle_the_readings(spark):
    rows = spark.range(50).select(F.concat(F.lit("b"), F.col("id") % 5).alias("building_id"), F.col("id").alias("v"))
    gone = spark.createDataFrame([("b1",), ("b1",)], "building_id string")
    small, large = cleaning.exclude_buildings(rows, gone), cleaning.exclude_buildings(rows, gone, broadcast_rows=0)
    assert "BroadcastHashJoin" in plan_of(small) and sorted(small.collect()) == sorted(large.collect()) and small.count() == 40
