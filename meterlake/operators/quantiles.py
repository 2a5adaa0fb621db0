"""Exact group statistics with interpolated quantiles, for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is fine for ordinary groups. In hot groups the
wanted ranks are found by radix selection: a double's bits, read as a signed integer in the order of the doubles, are
counted 16 at a time. A round keeps, for each wanted rank, the one bucket that holds it, so after four rounds all 64 bits
of its value are known. A round is one map-side-combined count over the stored keys and bits, with at most 65,536 buckets
for each wanted prefix, however the values are clustered or repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import fits, matches

QUANTILE_ROWS = 1_000_000
_DIGIT = 16
_BROADCAST_ROWS = 500_000
_INFINITE, _NOT_A_NUMBER = 0x7FF << 52, 0x7FF8 << 48


def ordered_bits(x: Column) -> Column:
    """A double's 64 bits as a long that sorts as the double does; NaN above all, -0.0 as 0.0.

    Exponent and fraction are taken apart by exact scalings with powers of two, so it is the bit pattern itself (negated
    for negative numbers) without leaving generated code.
    """
    size = F.abs(x)
    near = F.floor(F.log2(size))
    two = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm may round over a power of two.
    exponent = F.when(two(near) > size, near - 1).when(two(near + 1) <= size, near + 1).otherwise(near)
    normal = (exponent + 1023) * F.lit(1 << 52) + ((size / two(exponent) - 1.0) * F.lit(2.0**52)).cast("long")
    tiny = (size * F.lit(2.0**1000) * F.lit(2.0**74)).cast("long")
    bits = (
        F.when(F.isnan(x), F.lit(_NOT_A_NUMBER))
        .when(size == 0.0, F.lit(0))
        .when(size == F.lit(float("inf")), F.lit(_INFINITE))
        .when(size < F.lit(2.0**-1022), tiny)
        .when(size.isNotNull(), normal)
    )
    return F.when(x < 0.0, -bits).otherwise(bits)


def from_bits(u: Column) -> Column:
    """The double of ordered_bits."""
    bits = F.abs(u)
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1))
    size = (
        F.when(bits == _INFINITE, F.lit(float("inf")))
        .when(exponent == 2047, F.lit(float("nan")))
        .when(exponent == 0, fraction.cast("double") * F.lit(2.0**-1074))
        .otherwise((fraction + F.lit(1 << 52)).cast("double") * F.pow(F.lit(2.0), exponent - 1075))
    )
    return F.when(u < 0, -size).otherwise(size)


def _digit(number: int) -> Column:
    """The 16 bits of round ``number``; the first ones carry the sign."""
    shifted = F.shiftright("__u", 64 - _DIGIT * (number + 1))
    return shifted if number == 0 else shifted.bitwiseAND(F.lit((1 << _DIGIT) - 1))


def _select(rows: DataFrame, first: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """keys, __q, __v: interpolated quantiles of the groups in ``first`` (keys, __d, __c: counts by leading bits)."""
    group = Window.partitionBy(*keys)
    sized = first.withColumns({"__to": F.sum("__c").over(group.orderBy("__d")), "__n": F.sum("__c").over(group)})
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("__q"), F.lit(high).alias("__high"), round_(F.lit(float(p)) * (F.col("__n") - 1)).cast("long").alias("__rank"))
            for i, p in enumerate(probs)
            for high, round_ in ((False, F.floor), (True, F.ceil))
        ]
    )
    start = F.col("__to") - F.col("__c")
    here = F.filter(ranks, lambda r: (r["__rank"] >= start) & (r["__rank"] < F.col("__to")))
    opened = sized.select(*keys, "__n", F.col("__d").alias("__prefix"), start.alias("__start"), F.explode(here).alias("__r"))
    opened = opened.select(*keys, "__n", "__prefix", "__r.__q", "__r.__high", (F.col("__r.__rank") - F.col("__start")).alias("__rank"))
    for number in range(1, 64 // _DIGIT):
        opened = cut_lineage(opened)
        wanted = opened.select(*[F.col(k).alias("__b_" + k) for k in keys], F.col("__prefix").alias("__b___prefix")).distinct()
        wanted = F.broadcast(wanted) if fits(wanted, _BROADCAST_ROWS) else wanted
        held = rows.withColumn("__prefix", F.shiftright("__u", 64 - _DIGIT * number))
        counted = held.join(wanted, matches([*keys, "__prefix"], "__b_"), "left_semi").groupBy(*keys, "__prefix", _digit(number).alias("__d"))
        bucket = Window.partitionBy(*keys, "__prefix").orderBy("__d")
        counted = counted.agg(F.count(F.lit(1)).alias("__c")).withColumn("__to", F.sum("__c").over(bucket))
        found = opened.select(*[F.col(c).alias("__b_" + c) for c in keys], F.col("__prefix").alias("__b___prefix"), "__n", "__q", "__high", "__rank")
        found = counted.join(found, matches([*keys, "__prefix"], "__b_"))
        found = found.filter((F.col("__rank") < F.col("__to")) & (F.col("__rank") >= F.col("__to") - F.col("__c")))
        opened = found.select(
            *keys, "__n", (F.shiftleft("__prefix", _DIGIT) + F.col("__d")).alias("__prefix"), "__q", "__high",
            (F.col("__rank") - F.col("__to") + F.col("__c")).alias("__rank"),
        )
    value = from_bits(F.col("__prefix"))
    ends = opened.groupBy(*keys, "__q", "__n").agg(
        F.max(F.when(~F.col("__high"), value)).alias("__low"), F.max(F.when(F.col("__high"), value)).alias("__top")
    )
    place = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__q") + 1) * (F.col("__n") - 1)
    # As percentile interpolates.
    between = (F.ceil(place) - place) * F.col("__low") + (place - F.floor(place)) * F.col("__top")
    return ends.select(*keys, "__q", F.when(F.col("__low") == F.col("__top"), F.col("__low")).otherwise(between).alias("__v"))


def grouped_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    value: str,
    quantiles: Mapping[str, float],
    limit: int = QUANTILE_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """One row per group: the given (mergeable) aggregates and the named exact quantiles of ``value``.

    With no keys, one row for the whole table. ``split=False`` says that no group has more than ``limit`` values. Otherwise
    keys and bits are stored once and counted by their leading bits, which tells the group sizes too; the input itself is
    read once more, for the aggregates.
    """
    if not keys:
        one = df.withColumn("__all", F.lit(1))
        return grouped_stats(one, ["__all"], aggregates, value, quantiles, limit, split).drop("__all")
    keys = list(keys)
    names, probs = list(quantiles), list(quantiles.values())
    exact = [F.percentile(value, p).alias(name) for name, p in quantiles.items()]
    if split is False:
        return df.groupBy(*keys).agg(*aggregates, *exact)
    stored = cut_lineage(df.select(*keys, ordered_bits(F.col(value).cast("double")).alias("__u")).filter(F.col("__u").isNotNull()))
    first = cut_lineage(stored.groupBy(*keys, _digit(0).alias("__d")).agg(F.count(F.lit(1)).alias("__c")))
    hot = cut_lineage(
        first.groupBy(*[F.col(k).alias("__b_" + k) for k in keys]).agg(F.sum("__c").alias("__n")).filter(F.col("__n") > limit).drop("__n")
    )
    if hot.isEmpty():
        return df.groupBy(*keys).agg(*aggregates, *exact)
    # At most total rows / limit groups are hot.
    hot = F.broadcast(hot) if fits(hot, _BROADCAST_ROWS) else hot
    on = matches(keys, "__b_")
    rest = stored.join(hot, on, "left_anti").withColumn("__x", from_bits(F.col("__u"))).groupBy(*keys)
    plain = rest.agg(*[F.percentile("__x", p).alias(name) for name, p in quantiles.items()])
    selected = _select(stored.join(hot, on, "left_semi"), first.join(hot, on, "left_semi"), keys, probs).groupBy(*keys)
    located = selected.agg(*[F.max(F.when(F.col("__q") == i, F.col("__v"))).alias(name) for i, name in enumerate(names)])
    found = plain.unionByName(located).withColumnsRenamed({k: "__b_" + k for k in keys})
    base = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    return base.join(found, on, "left").select(*base.columns, *names)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    limit: int = QUANTILE_ROWS,
    split: bool | None = None,
) -> DataFrame:
    return grouped_stats(df, keys, [], value, quantiles, limit, split)
