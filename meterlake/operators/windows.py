"""Lag, rolling, difference and expanding features, gap filling, gap intervals, and the hourly grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .skew import HOT_ROWS, chunk_rows, matches, needs_split, over_groups, split_hot

LAG_HOURS = (1, 24, 168)
DIFF_HOURS = (1, 24)
ROLLING = ((24, ("mean", "std", "min", "max")), (168, ("mean", "std")))
EXPANDING = ("mean", "std")

# From this many rows on, rolling windows are merged from blocks (see _add_long_rolling).
LONG_WINDOW = 48

_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_columns(target: str, hours: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"{target}_lag_{n}h": F.lag(target, n).over(w) for n in hours}


def diff_columns(target: str, hours: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"{target}_diff_{n}h": F.col(target) - F.lag(target, n).over(w) for n in hours}


def rolling_columns(target: str, windows, w: WindowSpec) -> dict[str, Column]:
    """Statistics of the previous rows; the current row is outside the frame. Unknown function names are skipped."""
    return {
        f"{target}_rolling_{size}h_{name}": _AGGREGATES[name](target).over(w.rowsBetween(-size, -1))
        for size, names in windows
        for name in names
        if name in _AGGREGATES
    }


def _add_long_rolling(
    frame: DataFrame, keys: list[str], order: list[str], target: str, size: int, names: Sequence[str]
) -> DataFrame:
    """Rolling statistics whose cost per row does not grow with the window.

    Rows are cut into blocks of ``size``. The previous ``size`` rows are the rest of one block and the beginning of the
    next, so running statistics of each block from both ends are merged. Spark would visit every row of every frame.
    """
    x = F.col(target)
    block = Window.partitionBy(*keys, "__block")
    head = block.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tail = block.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)

    def parts(span: WindowSpec) -> Column:
        wanted = {"n": F.count(x)}
        if "mean" in names or "std" in names:
            wanted["s"] = F.sum(x)
        if "std" in names:
            wanted["v"] = F.var_pop(x)
        wanted |= {f: _AGGREGATES[f](x) for f in ("min", "max") if f in names}
        return F.struct(*[c.over(span).alias(k) for k, c in wanted.items()])

    kept = frame.columns
    frame = frame.withColumn("__block", F.expr(f"(__row - 1) div {size}"))
    frame = frame.withColumn("__head", parts(head)).withColumn("__tail", parts(tail))
    frame = frame.withColumn("__tail", F.lag("__tail", size).over(Window.partitionBy(*keys).orderBy(*order)))

    zero = F.lit(0.0)
    a, b = (lambda f: F.col("__tail")[f]), (lambda f: F.col("__head")[f])
    na, nb = F.coalesce(a("n"), F.lit(0)), F.coalesce(b("n"), F.lit(0))
    n = na + nb
    out = {}
    for name in names:
        if name == "mean":
            merged = ratio(F.coalesce(a("s"), zero) + F.coalesce(b("s"), zero), n)
        elif name == "std":
            shift = F.coalesce(ratio(a("s"), na) - ratio(b("s"), nb), zero)
            square = F.coalesce(a("v"), zero) * na + F.coalesce(b("v"), zero) * nb + shift * shift * ratio(na * nb, n)
            merged = F.when(n > 1, F.sqrt(ratio(square, n - 1)))
        else:
            merged = (F.least if name == "min" else F.greatest)(a(name), b(name))
        out[f"{target}_rolling_{size}h_{name}"] = merged
    return frame.select(*kept, *[c.alias(k) for k, c in out.items()])


def add_temporal_features(
    df: DataFrame,
    target: str = "meter_reading",
    lags: Sequence[int] = LAG_HOURS,
    rolling=ROLLING,
    diffs: Sequence[int] = (),
    expanding: Sequence[str] = (),
    group_cols: Sequence[str] = ("building_id",),
    order: Sequence[str] = ("timestamp",),
    align: str = "rows",
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """All requested features over one window: a single shuffle.

    Positions stand for hours. ``align="time"`` first puts every group on a gap-free hourly grid, so that they do.
    """
    if align == "time":
        split = grid_needs_split(df, group_cols, order[0], limit, split)
        df = hourly_grid(df, group_cols, order[0], limit, split)
    reach = max([0, *lags, *diffs, *[size for size, _ in rolling]])
    known = [(size, [f for f in names if f in _AGGREGATES]) for size, names in rolling]
    short = [(size, names) for size, names in known if size < LONG_WINDOW]
    long = [(size, names) for size, names in known if size >= LONG_WINDOW and names]

    def build(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        added = {
            **lag_columns(target, lags, w),
            **rolling_columns(target, short, w),
            **diff_columns(target, diffs, w),
        }
        names = [c.alias(name) for name, c in added.items()]
        if not long:
            return frame.select("*", *names)
        frame = frame.select("*", *names, F.row_number().over(w).alias("__row"))
        for size, functions in long:
            frame = _add_long_rolling(frame, keys, order, target, size, functions)
        return frame.drop("__row")

    if reach and expanding:
        split = needs_split(df, group_cols, limit, split)
    out = over_groups(df, group_cols, order, build, reach, 0, limit, split) if reach else df
    return add_expanding_features(out, target, expanding, group_cols, order, limit, split) if expanding else out


def add_lag_features(df, target="meter_reading", hours=LAG_HOURS, group_cols=("building_id",), **options) -> DataFrame:
    return add_temporal_features(df, target, hours, (), group_cols=group_cols, **options)


def add_rolling_features(df, target="meter_reading", windows=ROLLING, group_cols=("building_id",), **options) -> DataFrame:
    return add_temporal_features(df, target, (), windows, group_cols=group_cols, **options)


def add_diff_features(df, target="meter_reading", hours=DIFF_HOURS, group_cols=("building_id",), **options) -> DataFrame:
    return add_temporal_features(df, target, (), (), hours, group_cols=group_cols, **options)


def add_expanding_features(
    df: DataFrame,
    target: str = "meter_reading",
    functions: Sequence[str] = EXPANDING,
    group_cols: Sequence[str] = ("building_id",),
    order: Sequence[str] = ("timestamp",),
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Statistics of all earlier rows of the group.

    Hot groups are cut into chunks; the moments of the chunks before a row's own are added to those inside its chunk.
    """
    wanted = [name for name in functions if name in _AGGREGATES]
    names = {name: f"{target}_expanding_{name}" for name in wanted}
    groups = list(group_cols)
    past = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    expanded = [_AGGREGATES[name](target).over(past).alias(names[name]) for name in wanted]
    if not needs_split(df, groups, limit, split):
        return df.select("*", *expanded)
    cold, hot = split_hot(df, groups, limit)
    plain = cold.select("*", *expanded)

    chunks = chunk_rows(hot, groups, order, rows=limit).drop("__own")
    x = F.col(target)
    totals = chunks.groupBy(*groups, "__chunk").agg(
        F.count(x).alias("__n"),
        F.avg(x).alias("__m"),
        (F.var_pop(x) * F.count(x)).alias("__ss"),
        F.min(x).alias("__lo"),
        F.max(x).alias("__hi"),
    )
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__c", ratio(F.sum(F.col("__m") * F.col("__n")).over(whole), F.sum("__n").over(whole)))
    step = F.col("__m") - F.col("__c")
    carried = totals.select(
        *[F.col(g).alias("__map_" + g) for g in groups],
        F.col("__chunk").alias("__map_chunk"),
        "__c",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__pn"),
        F.sum(step * F.col("__n")).over(before).alias("__ps"),
        F.sum(F.col("__ss") + step * step * F.col("__n")).over(before).alias("__pq"),
        F.min("__lo").over(before).alias("__plo"),
        F.max("__hi").over(before).alias("__phi"),
    )
    inside = Window.partitionBy(*groups, "__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    local = chunks.select(
        "*",
        F.count(x).over(inside).alias("__ln"),
        F.avg(x).over(inside).alias("__lm"),
        F.var_pop(x).over(inside).alias("__lv"),
        F.min(x).over(inside).alias("__llo"),
        F.max(x).over(inside).alias("__lhi"),
    )
    joined = local.join(carried, matches(groups, "__map_") & (F.col("__chunk") == F.col("__map_chunk")))
    zero = F.lit(0.0)
    shift = F.coalesce(F.col("__lm") - F.col("__c"), zero)
    n = F.col("__ln") + F.col("__pn")
    total = F.coalesce("__ps", zero) + shift * F.col("__ln")
    square = F.coalesce("__pq", zero) + (F.coalesce("__lv", zero) + shift * shift) * F.col("__ln")
    merged = {
        "mean": F.when(n > 0, F.col("__c") + ratio(total, n)),
        "std": F.when(n > 1, F.sqrt(F.greatest(ratio(square - ratio(total * total, n), n - 1), zero))),
        "min": F.least("__llo", "__plo"),
        "max": F.greatest("__lhi", "__phi"),
    }
    cut = joined.select(*df.columns, *[merged[name].alias(names[name]) for name in wanted])
    return plain.unionByName(cut)


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    group_cols: Sequence[str],
    max_gap: int = 2,
    method: str = "both",
    order: Sequence[str] = ("timestamp",),
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Carry the last known value forward over at most ``max_gap`` rows, then the next one backward likewise."""
    if method not in ("forward", "backward", "both"):
        raise ValueError(f"unknown fill method {method!r}")
    columns = list(columns)

    def build(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        if method in ("forward", "both"):
            w_back = w.rowsBetween(-max_gap, 0)
            frame = frame.withColumns({c: F.last(c, ignorenulls=True).over(w_back) for c in columns})
        if method in ("backward", "both"):
            w_ahead = w.rowsBetween(0, max_gap)
            frame = frame.withColumns({c: F.first(c, ignorenulls=True).over(w_ahead) for c in columns})
        return frame

    filled = over_groups(df, group_cols, order, build, max_gap, max_gap, limit, split)
    return filled.select(*df.columns)


def grid_needs_split(
    df: DataFrame, group_cols: Sequence[str], time_col: str = "timestamp", limit: int = HOT_ROWS, split: bool | None = None
) -> bool:
    """Whether some group would have more than ``limit`` hours, from its first and last timestamp alone."""
    if split is not None:
        return split
    seconds = F.unix_seconds(F.max(time_col).cast("timestamp")) - F.unix_seconds(F.min(time_col).cast("timestamp"))
    hours = df.groupBy(*group_cols).agg((seconds / 3600 + 1).alias("__hours"))
    return not hours.filter(F.col("__hours") > limit).isEmpty()


def hourly_grid(
    df: DataFrame,
    group_cols: Sequence[str] = ("building_id",),
    time_col: str = "timestamp",
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """One row per group and hour between its first and last; added hours have NULL in the other columns.

    Expects readings at whole hours, one per group and hour. Each row is followed by the hours up to the next one, so the
    grid needs no join, and a later window over the same groups no further shuffle.
    """
    groups = list(group_cols)
    t = F.col(time_col)

    def build(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn("__next", F.lead(time_col).over(w))

    chained = over_groups(df.filter(t.isNotNull()), groups, [time_col], build, 0, 1, limit, split)
    gap = F.expr(f"sequence(`{time_col}` + interval 1 hour, __next - interval 1 hour, interval 1 hour)")
    added = F.when(F.col("__next") > t + F.expr("interval 1 hour"), gap)
    hours = F.concat(F.array(t), F.coalesce(added, F.array().cast("array<timestamp_ntz>")))
    exploded = chained.select(*df.columns, F.posexplode(hours).alias("__i", "__hour"))
    observed = F.col("__i") == 0
    return exploded.select(
        *[
            F.col("__hour").alias(c) if c == time_col else F.col(c) if c in groups else F.when(observed, F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def gap_intervals(
    df: DataFrame,
    group_cols: Sequence[str] = ("building_id",),
    time_col: str = "timestamp",
    step: str = "1 hour",
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Gaps of each group as intervals (gap_start, gap_end, missing_steps), at most one a row, however long it is.

    A gap lies between a row and its successor more than one step later; its missing times are the row's own plus one,
    two, ... steps before the successor. Rows without a time are left out, repeated times make no gap, a NULL group is a
    group, and a group without a gap has no row.
    """
    groups = list(group_cols)

    def build(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn("__next", F.lead("__t").over(w))

    times = df.filter(F.col(time_col).isNotNull()).select(*groups, F.col(time_col).alias("__t"))
    chained = over_groups(times, groups, ["__t"], build, 0, 1, limit, split)
    missing = F.expr(f"(__next - __t - interval 1 microsecond) div (interval {step})")
    gaps = chained.filter(F.expr(f"__next > __t + interval {step}")).withColumn("__missing", missing)
    return gaps.select(
        *groups,
        F.expr(f"__t + interval {step}").alias("gap_start"),
        F.expr(f"__t + interval {step} * __missing").alias("gap_end"),
        F.col("__missing").alias("missing_steps"),
    )


def add_weather_rolling(
    weather: DataFrame,
    column: str = "air_temperature",
    windows: Sequence[int] = (24, 72),
    group_cols: Sequence[str] = ("site_id",),
    limit: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Moving averages including the current hour, and the deviation from the first of them.

    Runs on the weather table, before it is joined to the meters: after the join, n rows of a site are not n hours.
    """

    def build(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        means = {f"{column}_rolling_{n}h": F.avg(column).over(w.rowsBetween(1 - n, 0)) for n in windows}
        return frame.select("*", *[mean.alias(name) for name, mean in means.items()])

    rolled = over_groups(weather, group_cols, ["timestamp"], build, max(windows) - 1, limit=limit, split=split)
    first = windows[0]
    return rolled.withColumn(f"{column}_diff_{first}h_mean", F.col(column) - F.col(f"{column}_rolling_{first}h"))
