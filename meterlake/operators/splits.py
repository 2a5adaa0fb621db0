"""Time, position, site and fold splits, and seeded choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ntz_literal
from ..session import cut_lineage
from .skew import HOT_ROWS, needs_split, row_positions, split_hot


def seeded_key(columns: Sequence[str], seed: int) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def _bucket_of_rank(times: DataFrame, unit: str, rank: Column | None, share: float) -> DataFrame:
    """One row: the ``unit`` that holds the wanted 0-based rank, and the ``rank`` within it."""
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy())) if rank is None else rank
    before = F.col("to") - F.col("n")
    return (
        times.groupBy(F.date_trunc(unit, "t").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"to": F.sum("n").over(running), "at": wanted})
        .filter((F.col("at") >= before) & (F.col("at") < F.col("to")))
        .select("bucket", (F.col("at") - before).alias("rank"))
    )


def split_time(df: DataFrame, share: float = 0.8, time_col: str = "timestamp") -> DataFrame:
    """One row: the distinct timestamp at 0-based position floor(share * n).

    The distinct timestamps are stored once. Counts per day find the day of that position, counts per minute of this day the minute; only the timestamps of one
    minute are ranked. The windows run over days, over the minutes of one day, and over one minute.
    """
    times = cut_lineage(df.select(F.col(time_col).alias("t")).filter("t is not null").distinct())
    day = _bucket_of_rank(times, "day", None, share).select(F.struct("bucket", "rank")).scalar()
    of_day = times.filter(F.date_trunc("day", "t") == day["bucket"])
    minute = _bucket_of_rank(of_day, "minute", day["rank"], share).select(F.struct("bucket", "rank")).scalar()
    of_minute = of_day.filter(F.date_trunc("minute", "t") == minute["bucket"])
    ranked = of_minute.withColumn("r", F.row_number().over(Window.orderBy("t")) - 1)
    return ranked.filter(F.col("r") == minute["rank"]).select(F.col("t").alias("split_timestamp"))


def time_split(
    df: DataFrame, share: float = 0.8, time_col: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """(train, test): before the split timestamp, and from it on.

    The timestamp is looked up first, so that both filters are plain comparisons that reach the scan.
    """
    found = split_time(df, share, time_col).first()
    at = ntz_literal(None if found is None else found[0])
    return df.filter(F.col(time_col) < at), df.filter(F.col(time_col) >= at)


def mark_client_split(
    df: DataFrame,
    client: str,
    order: Sequence[str],
    share: float = 0.8,
    name: str = "is_train",
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Per client, the first floor(share * n) rows in time order are training rows."""

    def mark(frame: DataFrame, position: Column, size: Column) -> DataFrame:
        return frame.select(*df.columns, (position < F.floor(size * F.lit(share))).alias(name))

    rows = Window.partitionBy(client)
    number, size = F.row_number().over(rows.orderBy(*order)) - 1, F.count(F.lit(1)).over(rows)
    if not needs_split(df, [client], limit, split):
        return mark(df, number, size)
    cold, hot = split_hot(df, [client], limit)
    placed = row_positions(hot, [client], order)
    return mark(cold, number, size).unionByName(mark(placed, F.col("__pos"), F.col("__size")))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int = 10_000, seed: int = 42) -> DataFrame:
    """min(n, rows) rows without replacement, the same on every run. ``keys`` identify a row.

    The rows with the smallest keys are taken. Keys are evenly spread, so on a large table a bound somewhat above the n-th
    one is set first, and raised until enough rows lie below it: only these are sorted, not n rows of every task.
    """
    keyed = df.withColumn("__key", seeded_key(keys, seed))
    fraction = (n + 10 * n**0.5 + 100) / max(df.count(), 1)
    while fraction < 1:
        below = keyed.filter(F.col("__key") < format(int(fraction * 2**32), "08x"))
        if below.count() >= n:
            keyed = below
            break
        fraction *= 2
    return keyed.orderBy("__key", *keys).limit(n).drop("__key")


def held_out_sites(df: DataFrame, share: float = 0.2, seed: int = 42, column: str = "site_id") -> DataFrame:
    """floor(share * sites) sites in seeded order. The window runs over the distinct sites only."""
    sites = df.select(column).filter(F.col(column).isNotNull()).distinct()
    sites = sites.withColumn("__key", seeded_key([column], seed))
    ranked = sites.select(
        column,
        F.row_number().over(Window.orderBy("__key")).alias("__r"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"),
    )
    return ranked.filter(F.col("__r") <= F.floor(F.col("__n") * F.lit(share))).select(column)


def site_split(df: DataFrame, share: float = 0.2, seed: int = 42, column: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """(rows of seen sites, rows of held-out sites)."""
    held = held_out_sites(df, share, seed, column)
    return df.join(held, column, "left_anti"), df.join(held, column, "left_semi")


def time_folds(
    df: DataFrame,
    n_splits: int = 5,
    test_months: int = 1,
    gap_months: int = 0,
    method: str = "rolling",
    train_months: int | None = None,
    time_col: str = "timestamp",
) -> DataFrame:
    """The fold table, newest month last: month numbers (year * 12 + month - 1) of each fold's train and test ranges.

    "expanding" trains on everything before the gap; "rolling" on the last ``train_months`` of it, by default the length
    that the first fold has.
    """
    month = F.year(time_col) * 12 + F.month(time_col) - 1
    span = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    folds = span.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold"))
    test_from = F.col("hi") - (F.lit(n_splits) - F.col("fold") + 1) * test_months + 1
    train_to = F.col("test_from") - gap_months - 1
    folds = folds.withColumn("test_from", test_from).withColumn("test_to", F.col("test_from") + test_months - 1)
    folds = folds.withColumn("train_to", train_to)
    first_length = F.col("hi") - n_splits * test_months - gap_months - F.col("lo") + 1
    length = first_length if train_months is None else F.lit(train_months)
    start = F.col("lo") if method == "expanding" else F.greatest(F.col("lo"), F.col("train_to") - length + 1)
    return folds.withColumn("train_from", start).select("fold", "train_from", "train_to", "test_from", "test_to")


def assign_folds(df: DataFrame, folds: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """Rows once per fold and role ("train" or "test"). The folds are expanded to months, which makes it an equi-join."""
    months = folds.select("fold", F.lit("train").alias("role"), F.explode(_months("train")).alias("__month")).unionByName(
        folds.select("fold", F.lit("test").alias("role"), F.explode(_months("test")).alias("__month"))
    )
    month = F.year(time_col) * 12 + F.month(time_col) - 1
    return df.withColumn("__month", month).join(F.broadcast(months), "__month").drop("__month")


def _months(role: str) -> Column:
    low, high = F.col(f"{role}_from"), F.col(f"{role}_to")
    return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
