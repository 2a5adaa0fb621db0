"""Files in and out."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterlake.schemas import METADATA, MissingColumns
from meterlake.sources import files, meters, provenance


def write(path, text):
    path.write_text(text)
    return str(path)


META = "building_id,site_id,primary_use,square_feet,year_built,floor_count\nb1,s1, Office ,100.5,1990,2\nb2,s1,Lab,,,\n"


def test_csv_schema_is_matched_by_name(spark, tmp_path):
    swapped = "site_id,building_id,primary_use,square_feet,year_built,floor_count,extra\ns1,b1,Office,100.5,1990,NaN,x\n"
    row = files.read_metadata(spark, write(tmp_path / "m.csv", swapped)).first()
    assert row.asDict() == {"building_id": "b1", "site_id": "s1", "primary_use": "Office", "square_feet": 100.5, "year_built": 1990, "floor_count": None}


def test_missing_column_strict_and_not(spark, tmp_path):
    path = write(tmp_path / "m.csv", "building_id,site_id\nb1,s1\n")
    with pytest.raises(MissingColumns):
        files.read_csv(spark, path, METADATA)
    assert files.read_csv(spark, path, METADATA, strict=False).columns == ["building_id", "site_id"]


def test_first_meter_file_wins(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        meters.read_meters(spark, str(tmp_path))
    write(tmp_path / "meter_readings.csv", "building_id,timestamp,reading\nb,2024-01-01 00:00:00,3\n")
    write(tmp_path / "electricity.csv", "building_id,timestamp,reading\nb,2024-01-01 00:00:00,2\n")
    assert meters.read_meters(spark, str(tmp_path)).first()["reading"] == 2


def test_meter_types(spark, tmp_path):
    wide = "timestamp,b1,b2\n2024-01-01 01:00:00,3,\n2024-01-01 00:00:00,1,2\n"
    write(tmp_path / "electricity.txt", wide)
    write(tmp_path / "electricity.csv", "timestamp,zz\n2024-01-01,9\n")
    write(tmp_path / "steam.csv", wide.replace("timestamp", "when"))
    out = meters.read_meter_types(spark, str(tmp_path))
    assert out.count() == 4 and {r["meter"] for r in out.collect()} == {"electricity"}
    capped = meters.read_meter_types(spark, str(tmp_path), row_cap=1)
    assert {r["timestamp"] for r in capped.collect()} == {datetime(2024, 1, 1)}
    with pytest.raises(FileNotFoundError):
        meters.read_meter_types(spark, str(tmp_path), ["hotwater"])


def test_wide_file_first_buildings(spark, tmp_path):
    path = write(tmp_path / "electricity.txt", "timestamp,b1,b2\n2024-01-01 00:00:00,1,\n2024-01-01 01:00:00,,4\n")
    assert meters.read_wide_long(spark, path, buildings=1).count() == 2
    kept = meters.read_wide_long(spark, path, drop_missing=True).collect()
    assert {(r["building_id"], r["meter_reading"]) for r in kept} == {("b1", 1.0), ("b2", 4.0)}


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5, True, None), ("b", None, -1.0, False, [1, 2])], "k string, n bigint, x double, f boolean, v array<int>")
    files.write_report({"part": df}, str(tmp_path / "r"))
    back = files.read_json(spark, str(tmp_path / "r" / "part"), df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert files.read_report(spark, str(tmp_path / "r"), ["part"])["part"].count() == 2
    assert files.as_json(df).filter("json like '%null%'").count() == 2


def test_readings_are_stored_by_site(spark, tmp_path):
    df = spark.range(100).selectExpr("string(id % 3) site_id", "string(id % 7) building_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) timestamp", "double(id) meter_reading")
    files.write_readings(df, str(tmp_path / "t"))
    back = files.read_parquet(spark, str(tmp_path / "t"))
    part = back.filter(F.col("site_id") == "1")
    assert part.count() == 33 and "PartitionFilters: [isnotnull(site_id" in part._jdf.queryExecution().executedPlan().toString()


def test_exports(spark, tmp_path):
    df = spark.range(20).selectExpr("string(id % 2) building_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) timestamp", "double(id) actual")
    files.export_sample(df, str(tmp_path / "s"), 5)
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).agg(F.max(F.col("actual").cast("double"))).first()[0] == 4.0
    many = df.crossJoin(spark.range(50).select(F.col("id").alias("x")))
    order = ["timestamp", "building_id", "x"]
    for n in (1, 50, 120, 5000):
        assert files.head(many, n, order).collect() == many.orderBy(*order).limit(n).collect()
    files.export_scored(df, str(tmp_path / "one"), "1")
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 10
    files.export_scored(df, str(tmp_path / "all"))
    assert sorted(p.name for p in (tmp_path / "all").glob("building_id=*")) == ["building_id=0", "building_id=1"]


def test_provenance(spark, tmp_path):
    folder = tmp_path / "raw files"
    folder.mkdir()
    write(folder / "metadata.csv", META)
    (folder / "train.csv").write_bytes(b"x" * 5_000_000)
    rows = {r["filename"]: r for r in provenance.provenance(spark, str(folder), source="here").collect()}
    for name, row in rows.items():
        content = (folder / name).read_bytes()
        assert row["checksum_sha256"] == hashlib.sha256(content).hexdigest() and row["file_size_bytes"] == len(content)
    log = str(tmp_path / "log")
    for _ in range(2):
        provenance.log_provenance(provenance.provenance(spark, str(folder)), log)
    assert spark.read.parquet(log).count() == 4
    assert [r[0] for r in provenance.missing_inputs(spark, str(folder)).collect()] == ["weather.csv"]
    assert not provenance.inputs_complete(spark, str(folder))
    write(folder / "weather.csv", "site_id\n")
    assert provenance.inputs_complete(spark, str(folder))


def test_wide_file_is_typed_from_its_header(spark, tmp_path):
    path = str(tmp_path / "w.csv")
    (tmp_path / "w.csv").write_text("timestamp,a.1,b\n2024-01-01 00:00:00,1.5,oops\n2024-01-01 01:00:00,nan,2\n2024-01-01 02:00:00,,-\n")
    spark.sparkContext.setJobGroup("header", "reads before use")
    wide, rejected = meters.read_wide(spark, path)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("header")) <= 1
    assert [tuple(r)[1:] for r in wide.orderBy("timestamp").collect()] == [(1.5, None), (None, 2.0), (None, None)]
    bad = sorted(map(tuple, rejected.collect()))
    assert bad == [("2024-01-01 00:00:00", "b", "oops"), ("2024-01-01 02:00:00", "b", "-")]
    assert meters.read_wide_long(spark, path, drop_missing=True).count() == 2
    (tmp_path / "y.csv").write_text("a,b\n2016,1\n2017,2\n")
    with pytest.raises(ValueError):
        meters.read_wide(spark, str(tmp_path / "y.csv"))
