"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.session import cut_lineage, scratch_path

TOKENIZER = "byte_bpe_50k"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as a table in the shared folder and read back, so that later passes don't repeat the work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of (a, b) edges: one row (id, root) for each id of any edge, root being the smallest id.

    Every round points each node and its neighbours at the smallest of them, then shortens paths; each round is
    checkpointed. A hub's neighbours are min-aggregated map-side, so no group is gathered in one task. No edges: no rows.
    Raises where `rounds` don't suffice, so that no partial answer gets out.
    """
    both = cut_lineage(
        edges.select(F.col("a").alias("id"), F.col("b").alias("to"))
        .unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        .where("id <> to")
        .distinct()
    )
    roots = cut_lineage(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("root")))
    for _ in range(rounds):
        # The smallest root among the neighbours, offered to the node and to its present root.
        seen = both.join(roots.select(F.col("id").alias("to"), F.col("root").alias("near")), "to").groupBy("id").agg(F.min("near").alias("near"))
        offer = roots.join(seen, "id").select("id", "root", F.least("root", "near").alias("low"))
        hooked = (
            offer.select("id", F.col("low"))
            .unionByName(offer.where("low < root").select(F.col("root").alias("id"), "low"))
            .groupBy("id")
            .agg(F.min("low").alias("low"))
        )
        jump = hooked.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        following = cut_lineage(
            hooked.join(jump, "low", "left").select("id", F.coalesce("lower", "low").alias("root"))
        )
        changed = roots.join(following.withColumnRenamed("root", "new"), "id").where("new <> root").limit(1).count()
        roots = following
        if not changed:
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Each row's position in the order, from 0. Ranges of rows are numbered in parallel, from sums over the ranges."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(begins, "_range").withColumn(name, place + F.col("_begin")).drop("_range", "_begin")


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of `bits` (a power of two) low hash values occur, as bits of uint64 words: at most `bits` / 64 rows are collected."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftrightunsigned(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(max(1, bits // 64), dtype=np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(64 * len(words) - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def maybe_among(ids: DataFrame, most_bits: int = 1 << 27) -> Column:
    """Whether the row's `id` may be among the ids: a bitmap of 16 bits an id, of at most 16 MB, looked up without a shuffle."""
    hashes = cut_lineage(ids.select(F.xxhash64("id").alias("h")))
    bits = min(max(1 << 16, 1 << (16 * hashes.count()).bit_length()), most_bits)
    held = ids.sparkSession.sparkContext.broadcast(bitmap(hashes, "h", bits))

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, h.to_numpy().view(np.uint64)))

    return known(F.xxhash64("id"))


def rows_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose `id` is among the ids, as a semi-join that shuffles hardly any row beyond its id.

    A bitmap lets all wanted rows and a few others through. A join of ids alone finds those others, and a second bitmap, of
    them, tells which rows are surely wanted; only rows that both bitmaps know go through the exact join.
    """
    ids = cut_lineage(ids.select("id").distinct())
    may = maybe_among(ids)
    others = rows.select("id").where(may).distinct().join(ids, "id", "left_anti")
    doubt = maybe_among(others)
    passed = rows.where(may)
    return passed.where(~doubt).unionByName(passed.where(doubt).join(ids, "id", "left_semi"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
