"""Grouped work that stays balanced when one group holds a large share of all rows.

Groups up to ``limit`` rows go through the ordinary Spark operator. Whether there are larger ("hot") ones is checked
with a map-side-combined count, unless the caller says so with ``split``. There can be at most ``total rows / limit`` of
them, which is what bounds the lists of hot groups that are broadcast here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of
from ..session import cut_lineage

HOT_ROWS = 2_000_000


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k) for k in keys]


def matches(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the keys with their prefixed copies."""
    return all_of(F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys (prefixed with __hot_) and sizes of the groups with more than ``limit`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return sizes.filter(F.col("__rows") > limit).select(*_renamed(keys, "__hot_"), "__rows")


def needs_split(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS, split: bool | None = None) -> bool:
    """Whether some group has more than ``limit`` rows: one counting job, or the caller's own knowledge.

    A chain of operators on the same groups needs only one check, at its start, as long as no step adds rows.
    """
    return split if split is not None else not hot_groups(df, keys, limit).isEmpty()


def split_hot(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups)."""
    hot = F.broadcast(hot_groups(df, keys, limit).drop("__rows"))
    on = matches(keys, "__hot_")
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")


def row_positions(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based ``__pos`` of each row in its group and the group's ``__size``, for groups of any size.

    Rows are range-partitioned by (group, order), which splits a large group over many tasks, and written to reliable
    storage together with their partition number, so that counting and numbering see the same partitions. The offset of
    a partition within a group follows from the counts; there are at most groups + partitions of them.
    """
    ranged = df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    so_far = Window.partitionBy(*groups).orderBy("__part")
    counts = ranged.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *_renamed(groups, "__map_"),
        F.col("__part").alias("__map_part"),
        (F.sum("__n").over(so_far) - F.col("__n")).alias("__from"),
        F.sum("__n").over(Window.partitionBy(*groups)).alias("__size"),
    )
    here = Window.partitionBy(*groups, "__part").orderBy(*order)
    numbered = ranged.withColumn("__rank", F.row_number().over(here))
    on = matches(groups, "__map_") & (F.col("__part") == F.col("__map_part"))
    return numbered.join(offsets, on).select(*df.columns, (F.col("__from") + F.col("__rank") - 1).alias("__pos"), "__size")


def chunk_rows(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], back: int = 0, forward: int = 0, rows: int = HOT_ROWS
) -> DataFrame:
    """Rows with ``__pos`` and the ``__chunk`` of ``rows`` consecutive positions they belong to.

    A row is copied to the later chunks that start fewer than ``back`` rows after it, and to the earlier ones that end
    fewer than ``forward`` rows before it; such border copies have ``__own`` false.
    """
    placed = row_positions(df, groups, order)
    chunks = F.expr(
        f"sequence(greatest(__pos - {forward}, 0) div {rows}, least(__pos + {back}, __size - 1) div {rows}, 1)"
    )
    return placed.select(*df.columns, "__pos", F.explode(chunks).alias("__chunk")).withColumn(
        "__own", F.col("__chunk") == F.expr(f"__pos div {rows}")
    )


def over_groups(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    build: Callable[[DataFrame, list[str], list[str]], DataFrame],
    back: int = 0,
    forward: int = 0,
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Apply row-framed window expressions per group.

    ``build(frame, keys, order)`` adds the columns, over windows partitioned by ``keys`` and ordered by ``order``; its
    frames may look at most ``back`` rows behind and ``forward`` rows ahead. Ordinary groups are one window partition
    each; hot groups are cut into chunks of consecutive rows, each with the border rows that the frames need, so the
    result is the same.
    """
    if not needs_split(df, groups, limit, split):
        return build(df, list(groups), list(order))
    cold, hot = split_hot(df, groups, limit)
    plain = build(cold, list(groups), list(order))
    cut = build(chunk_rows(hot, groups, order, back, forward, limit), [*groups, "__chunk"], ["__pos"])
    return plain.unionByName(cut.filter("__own").drop("__own", "__chunk", "__pos"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Spark prunes to one row per key and task before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most ``rows`` rows. A plain count: it is combined per task and needs no columns."""
    return df.count() <= rows


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    broadcast_rows: int = 500_000,
    salt_hot: bool = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Left or inner join of a large table with a smaller one holding at most one row per key.

    The size of ``right`` is checked: up to ``broadcast_rows`` it is broadcast. Beyond that both sides are shuffled, rows
    with a NULL key (which match nothing) are spread by hash, and the rows of hot keys are spread over several tasks with
    as many copies of that key's one row on the right.
    """
    if fits(right, broadcast_rows):
        return left.join(F.broadcast(right), list(keys), how)
    others = [c for c, t in left.dtypes if c not in keys and not t.startswith("map")]
    # A left side of keys only has nothing else to tell its rows apart but their place. Any salt gives the same rows.
    spread = F.xxhash64(*others) if others else F.xxhash64(F.monotonically_increasing_id())
    if salt_hot:
        hot = F.broadcast(hot_groups(left, keys, limit))
        on = matches(keys, "__hot_")
        salts = F.coalesce(F.expr(f"__rows div {limit} + 1"), F.lit(1))
        left_salted = left.join(hot, on, "left").withColumn("__salt", F.pmod(spread, salts))
        right_salted = right.join(hot, on, "left").withColumn(
            "__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))
        )
        left_salted = left_salted.select(*left.columns, "__salt")
        right_salted = right_salted.select(*right.columns, "__salt")
    else:
        zero = F.lit(0).cast("bigint")
        left_salted, right_salted = left.withColumn("__salt", zero), right.withColumn("__salt", zero)
    unmatched = any_of(F.col(k).isNull() for k in keys)
    left_salted = left_salted.withColumn("__salt", F.when(unmatched, spread).otherwise(F.col("__salt")))
    return left_salted.join(right_salted, [*keys, "__salt"], how).drop("__salt")
