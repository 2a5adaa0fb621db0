"""Reading and writing tables and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, ntz_literal
from ..schemas import METADATA, WEATHER, has_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = True) -> DataFrame:
    """A CSV with a header. With a schema, columns are matched by name and cast; without one, types are inferred.

    ``strict`` raises on a missing column; otherwise it is left out, as are columns the schema does not name.
    """
    if schema is None:
        return nan_to_null(
            spark.read.option("header", True).option("inferSchema", True).option("nanValue", "nan").csv(path)
        )
    text = read_text_table(spark, path)
    has_columns(text, schema.fieldNames(), strict)
    present = [f for f in schema.fields if f.name in text.columns]
    typed = text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in present])
    return nan_to_null(typed)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with all columns as text: only the header line is read before the table is used."""
    return spark.read.option("header", True).csv(path)


def typed_cells(
    text: DataFrame, types: Mapping[str, T.DataType], keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(typed, rejected) of a text table: the named columns with their types, and the cells that don't fit them.

    A cell that is no value of its column's type is NULL in the first table and a row (keys, column, text) of the second,
    with the keys as text. Empty cells and "nan" are missing, not rejected. Both come from one projection of the same scan.
    """
    parsed = {c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()}
    typed = nan_to_null(text.select(*[v.alias(c) for c, v in parsed.items()]))
    bad = [
        F.when(F.col(f"`{c}`").isNotNull() & v.isNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")))
        for c, v in parsed.items()
    ]
    rejected = text.select(*keys, F.inline(F.filter(F.array(*bad), lambda cell: cell.isNotNull())))
    return typed, rejected


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; values of partition folders stay text, so that a site id such as '007' comes back unchanged."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return nan_to_null(spark.read.parquet(path))
    finally:
        spark.conf.set(name, before)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_readings(df: DataFrame, path: str, files_per_site: int = 0) -> None:
    """Readings partitioned by site on disk, sorted by building and time inside the files.

    Rows are range-partitioned by (site, building, time), so a large site is spread over many files and tasks.
    """
    keys = ["site_id", "building_id", "timestamp"]
    ranged = df.repartitionByRange(files_per_site, *keys) if files_per_site else df.repartitionByRange(*keys)
    write_parquet(ranged.sortWithinPartitions(*keys), path, ["site_id"])


def read_metadata(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read_csv(spark, path, METADATA, strict)


def read_weather(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return read_csv(spark, path, WEATHER, strict)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """Each section as JSON lines under its own folder."""
    for name, table in sections.items():
        write_json(table, f"{path}/{name}")


def read_report(spark: SparkSession, path: str, sections: Sequence[str]) -> dict[str, DataFrame]:
    return {name: read_json(spark, f"{path}/{name}") for name in sections}


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, keys in column order, NULL kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def head(df: DataFrame, n: int, order: Sequence[str] = ("timestamp", "building_id")) -> DataFrame:
    """The first n rows; ``order`` starts with a timestamp.

    Counts per hour tell which hours can contribute, so only their rows are sorted, not n rows of every task.
    """
    hour = F.date_trunc("hour", F.col(order[0])).cast("timestamp_ntz")
    running = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    hours = df.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    reached = hours.withColumn("to", F.sum("n").over(running)).filter(F.col("to") >= n)
    last = reached.agg(F.min("hour")).first()[0]
    early = df if last is None else df.filter(hour.isNull() | (hour <= ntz_literal(last)))
    return early.orderBy(*order).limit(n)


def export_sample(df: DataFrame, path: str, n: int = 10_000, order: Sequence[str] = ("timestamp", "building_id")) -> None:
    """The first n rows in time order, as CSV."""
    write_csv(head(df, n, order), path)


def export_scored(df: DataFrame, path: str, building_id: str | None = None) -> None:
    """Scored rows as CSV: one building, or all of them in one folder each."""
    if building_id is not None:
        write_csv(df.filter(F.col("building_id") == building_id), path)
    else:
        spread = df.repartitionByRange("building_id", "timestamp")
        spread.write.mode("overwrite").option("header", True).partitionBy("building_id").csv(path)
