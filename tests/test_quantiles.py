"""Radix selection of exact quantiles against percentile, whatever the values and the groups."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from meterlake.operators import quantiles
from meterlake.operators.quantiles import exact_quantiles, from_bits, grouped_stats, ordered_bits

PROBS = {"q0": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "q4": 1.0}


def test_bits_are_those_of_the_double_and_sort_like_it(spark):
    pick = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    values += [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, d) for e in range(-1070, 1023, 9) for d in (0, math.inf)]
    values += [struct.unpack("<d", pick.randbytes(8))[0] for _ in range(5000)]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered_bits(F.col("x")).alias("u"))
    got = rows.select("x", "u", from_bits(F.col("u")).alias("back")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.u == (-bits if r.x < 0 else bits) and r.back == r.x
    nan = spark.createDataFrame([(math.nan,), (None,)], "x double").select(ordered_bits(F.col("x")).alias("u"), from_bits(ordered_bits(F.col("x"))).alias("b")).collect()
    assert nan[0].u > max(r.u for r in got) and math.isnan(nan[0].b) and nan[1].u is None


VALUES = {
    "one value": lambda pick: 7.25,
    "ties": lambda pick: float(pick.choice([-3, -2, -2, 0, 0, 0, 5])),
    "a cluster and two far ends": lambda pick: pick.choice([-1e300, 1e300] + [1.0 + pick.random() * 1e-9] * 500),
    "both signs, many sizes": lambda pick: pick.choice([-1, 1]) * 10.0 ** pick.uniform(-310, 300),
    "NULLs": lambda pick: pick.choice([None, pick.random()]),
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_selected_quantiles_equal_percentile(spark, kind):
    pick = random.Random(2)
    groups = ["big"] * 20 + [None] * 12 + ["small", "tiny"]
    rows = [(pick.choice(groups), pick.randint(0, 1), VALUES[kind](pick)) for _ in range(6000)] + [("empty", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, x double")
    aggregates = [F.count("x").alias("n"), F.max("x").alias("most")]
    want = df.groupBy("k", "j").agg(*aggregates, *[F.percentile("x", p).alias(n) for n, p in PROBS.items()])
    for limit in (300, 0) if kind == "NULLs" else (300,):
        got = grouped_stats(df, ["k", "j"], aggregates, "x", PROBS, limit)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    whole = grouped_stats(df, [], [], "x", PROBS, 10).first()
    assert tuple(whole) == tuple(df.agg(*[F.percentile("x", p) for p in PROBS.values()]).first())


def test_a_round_holds_bounded_buckets_and_the_store_is_read_five_times(spark, monkeypatch):
    rows = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.lit(1.0) + F.rand(3) * 1e-12).alias("x"))
    stores, reads = [], []
    real = quantiles.cut_lineage

    def counted(df):
        out = real(df)
        if out.columns == ["k", "__u"]:
            seen = spark.sparkContext.accumulator(0)
            watched = F.udf(lambda u: (seen.add(1), u)[1], "long").asNondeterministic()
            stores.append(seen)
            return out.withColumn("__u", watched("__u"))
        if "__d" in out.columns:
            reads.append(out.groupBy("k").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "cut_lineage", counted)
    got = exact_quantiles(rows, ["k"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, limit=100)
    want = rows.groupBy("k").agg(*[F.percentile("x", p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    assert sorted(got.collect()) == sorted(want.collect())
    assert len(stores) == 1 and stores[0].value <= 5 * 40_000 and max(reads) <= 65_536


def test_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", {"median": 0.5}).count() == 0
    assert exact_quantiles(spark.createDataFrame([], "k string, x double"), [], "x", {"median": 0.5}).count() == 0
