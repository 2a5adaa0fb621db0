"""The three entry points end to end, on files derived from the shared tables."""

import pytest
from pyspark.sql import functions as F

from meterlake.catalog import views
from meterlake.plans import exploration, preparation, scored, training
from meterlake.sources import files


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """A raw data folder: long electricity readings of one meter per hour, metadata and weather."""
    path = str(tmp_path_factory.mktemp("data"))
    readings = views.kept(spark, sf).select("building_id", "timestamp", "meter_reading").withColumn("meter", F.lit(0))
    files.write_csv(readings, f"{path}/raw/electricity.csv")
    files.write_csv(views.metadata(spark, sf).withColumn("floor_count", F.coalesce("floor_count", F.lit(2.0))), f"{path}/raw/metadata.csv")
    files.write_csv(views.weather(spark, sf), f"{path}/raw/weather.csv")
    wide = views.wide(spark, sf)
    files.write_csv(wide, f"{path}/meters/electricity.txt")
    files.write_csv(wide.select("timestamp", "S1", "S2", "S3"), f"{path}/meters/steam.csv")
    return path


def test_modelling_path(spark, sf, folder):
    processed = preparation.run_cleaning(spark, f"{folder}/raw", f"{folder}/out", 2025, start="2024-01-01", end="2024-12-31")
    assert processed.count() == views.kept(spark, sf).count()
    assert {"relative_humidity", "air_temperature_rolling_72h", "building_age", "site_id"} <= set(processed.columns)
    assert spark.read.parquet(f"{folder}/out/weather_clean").count() == views.weather(spark, sf).count()

    table = preparation.run_features(spark, f"{folder}/out/processed", f"{folder}/out/features")
    assert table.filter("meter_reading_lag_24h is null or meter_reading is null").count() == 0
    dummies = [c for c in table.columns if c.startswith("use_")]
    assert 2 <= len(dummies) <= 11
    assert table.filter(F.expr("+".join(f"`{c}`" for c in dummies)) != 1).count() == 0

    metrics = training.run_training(spark, f"{folder}/out/features", f"{folder}/out", maxIter=3)
    assert {r["model"] for r in metrics.collect()} == {"trees", "additive"}
    rows = scored.read_scored(spark, f"{folder}/out/scored")
    r2 = scored.score_buildings(rows)
    building = r2.first()["building_id"]
    series = scored.series(rows, building)
    assert series.columns == ["timestamp", "actual", "predicted_trees", "predicted_additive"] and series.count() > 0
    assert "PushedFilters: [IsNotNull(building_id)" in series._jdf.queryExecution().executedPlan().toString()


def test_client_rounds(spark, folder, sf):
    table = spark.read.parquet(f"{folder}/out/features")
    out = training.client_round_metrics(table, ["meter_reading_lag_1h", "meter_reading_lag_24h"], rounds=2)
    assert out.count() == 2 and out.filter("avg_rmsle > 0").count() == 2


def test_exploration_path(spark, sf, folder):
    exploration.run_exploration(spark, f"{folder}/meters/electricity.txt", f"{folder}/meters", f"{folder}/eda", max_missing=0.95)
    hourly = files.read_json(spark, f"{folder}/eda/temporal_analysis/hourly_stats")
    total = files.read_json(spark, f"{folder}/eda/temporal_analysis/summary").first()
    assert hourly.agg(F.sum("count")).first()[0] == total["total_records"]
    meters = files.read_json(spark, f"{folder}/eda/meter_analysis/summary").first()
    assert meters["meter_types_analyzed"] == "electricity,steam" and meters["total_buildings"] == 28
    assert files.read_json(spark, f"{folder}/eda/building_analysis/summary").first()["total_buildings"] > 0
    cleaned = spark.read.parquet(f"{folder}/eda/cleaned")
    sample = spark.read.option("header", True).csv(f"{folder}/eda/cleaned_sample")
    assert sample.count() == min(10_000, cleaned.count()) and cleaned.filter("meter_reading < 0").count() == 0
