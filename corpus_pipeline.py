"""Corpus pipeline: quality, language, near duplicates, decontamination and packing, each stage a table for the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontamination, jaccard, language, packing, quality
from meterlake.llm.common import rows_among, table
from meterlake.session import bound_batches, scratch_path


def in_small_batches(stage: Callable) -> Callable:
    """The stage with Python workers that hold a few megabytes of texts at once, as they live on from stage to stage."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


def kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of documents whose id is among those of the decisions, with the documents' columns."""
    return docs.join(decisions.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; NULL and empty texts go."""
    return kept(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("accepted"))


@in_small_batches
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a wide enough margin; texts without letters go."""
    return kept(docs, language.identify(docs, language.learn_dictionaries(docs)).where("accepted"))


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; unlinked documents stay.

    Linked: a Jaccard similarity of at least 0.8 on shingles of five words.
    """
    first = jaccard.near_groups(docs, n=5, percent=80).where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    return rows_among(whole, first).select("row.*")


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    hit = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Models and iterations aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
