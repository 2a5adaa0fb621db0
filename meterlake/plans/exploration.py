"""The exploratory path: reports on long readings, and the exploratory cleaner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_long, drop_any_null
from ..reports.building import building_report
from ..reports.meter import meter_report
from ..reports.temporal import temporal_report
from ..sources.files import export_sample, write_parquet, write_report
from ..sources.meters import read_meter_types, read_wide_long


def explore(readings: DataFrame, meters: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """All report sections; ``readings`` are of one meter type, ``meters`` of several."""
    present = drop_any_null(readings.select("timestamp", "building_id", "meter_reading"))
    return {
        "temporal_analysis": temporal_report(present),
        "building_analysis": building_report(present),
        "meter_analysis": meter_report(meters),
    }


def run_exploration(
    spark: SparkSession, wide_path: str, meter_dir: str, out_dir: str, buildings: int | None = None, **cleaning
) -> None:
    """Reads the wide file once into a long table, then writes the reports and the cleaned readings."""
    write_parquet(read_wide_long(spark, wide_path, buildings), f"{out_dir}/long")
    long = spark.read.parquet(f"{out_dir}/long")
    for name, sections in explore(long, read_meter_types(spark, meter_dir)).items():
        write_report(sections, f"{out_dir}/{name}")
    write_parquet(clean_long(long, **cleaning), f"{out_dir}/cleaned")
    export_sample(spark.read.parquet(f"{out_dir}/cleaned"), f"{out_dir}/cleaned_sample")
