"""Which input files are there, and what exactly was in them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("metadata.csv", "weather.csv")
ANY_OF = ("train.csv", "electricity.csv")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, filename, file_size_bytes, modified) without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def _sha256(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hash files in blocks, so that a task's memory does not depend on the file size."""
    import hashlib
    from urllib.parse import quote

    from pyarrow import fs

    def digest(path: str) -> str:
        system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@=%"))
        h = hashlib.sha256()
        with system.open_input_stream(inner) as stream:
            while block := stream.read(1 << 22):
                h.update(block)
        return h.hexdigest()

    for paths in batches:
        yield paths.map(digest)


def provenance(spark: SparkSession, folder: str, pattern: str = "*", source: str | None = None) -> DataFrame:
    """One row per file with its size and SHA-256."""
    sha256 = F.pandas_udf(_sha256, "string")
    files = list_files(spark, folder, pattern).repartition("path")
    return files.select(
        "filename",
        F.lit(source).cast("string").alias("url"),
        sha256(F.regexp_replace("path", "^file:/+", "file:///")).alias("checksum_sha256"),
        "file_size_bytes",
        "modified",
    )


def log_provenance(files: DataFrame, path: str) -> None:
    """Append to the provenance table, stamped with the time of logging."""
    files.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def missing_inputs(
    spark: SparkSession, folder: str, required: Sequence[str] = REQUIRED, any_of: Sequence[str] = ANY_OF
) -> DataFrame:
    """Required files that are absent, and one row for the meter files if none of them is there."""
    present = list_files(spark, folder).select("filename")
    groups = [(name, name) for name in required] + [("|".join(any_of), name) for name in any_of]
    expected = spark.createDataFrame(groups, "requirement string, filename string")
    found = expected.join(F.broadcast(present.filter(F.col("filename").isin([n for _, n in groups]))), "filename", "left_semi")
    return expected.select("requirement").distinct().join(found.select("requirement"), "requirement", "left_anti")


def inputs_complete(spark: SparkSession, folder: str, **options) -> bool:
    return missing_inputs(spark, folder, **options).isEmpty()
