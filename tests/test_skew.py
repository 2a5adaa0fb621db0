"""The paths for groups too large for one task give the same results as the ordinary ones and as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.operators import windows
from meterlake.operators.cleaning import exclude_buildings
from meterlake.operators.quantiles import exact_quantiles, grouped_stats
from meterlake.operators.skew import hot_groups, lookup_join, needs_split, row_positions

LIMIT = 40


@pytest.fixture(scope="module")
def frame():
    """One building with most rows, gaps of days, a NULL group, and missing readings."""
    rng = np.random.default_rng(7)
    parts = []
    for name, n, span in (("hot", 700, 1500), ("warm", 45, 2000), ("small", 20, 60), (None, 90, 400)):
        hours = np.sort(rng.choice(span, n, replace=False))
        values = np.round(rng.normal(1000, 3, n), 3)
        parts.append(pd.DataFrame({"building_id": name, "h": hours, "meter_reading": np.where(rng.random(n) < 0.2, np.nan, values)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["timestamp"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.pop("h"), unit="h")
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(b, t.to_pydatetime(), None if np.isnan(v) else float(v)) for b, v, t in frame.itertuples(index=False)]
    made = spark.createDataFrame(rows, "building_id string, timestamp timestamp_ntz, meter_reading double")
    return made.repartition(5).persist()


def pandas_of(out):
    pdf = out.toPandas().sort_values(["building_id", "timestamp"], na_position="last").reset_index(drop=True)
    return pdf.astype({c: float for c in pdf.columns if c.startswith("meter")})


def assert_same(a, b):
    pd.testing.assert_frame_equal(pandas_of(a), pandas_of(b)[list(a.columns)], rtol=1e-9, atol=1e-9)


def test_check_finds_hot_groups(df):
    assert needs_split(df, ["building_id"], LIMIT) and not needs_split(df, ["building_id"], 10_000)
    assert not needs_split(df, ["building_id"], LIMIT, split=False)
    assert {r[0] for r in hot_groups(df, ["building_id"], LIMIT).collect()} == {"hot", "warm", None}


@pytest.mark.parametrize("limit", [1, 7, LIMIT, 300])
def test_windows(df, limit):
    wanted = dict(lags=(1, 24, 168), rolling=((24, ("mean", "std", "min", "max")), (168, ("mean",))), diffs=(1, 24))
    plain = windows.add_temporal_features(df, split=False, **wanted)
    assert_same(plain, windows.add_temporal_features(df, limit=limit, **wanted))


@pytest.mark.parametrize("limit", [1, LIMIT])
@pytest.mark.parametrize("method", ["forward", "backward", "both"])
def test_fill(df, frame, limit, method):
    out = pandas_of(windows.fill_gaps(df, ["meter_reading"], ["building_id"], 2, method, limit=limit))
    want = frame.sort_values(["building_id", "timestamp"], na_position="last").reset_index(drop=True)
    group = want["building_id"].fillna("?")
    if method != "backward":
        want["meter_reading"] = want.groupby(group)["meter_reading"].ffill(limit=2)
    if method != "forward":
        want["meter_reading"] = want.groupby(group)["meter_reading"].bfill(limit=2)
    np.testing.assert_array_equal(out["meter_reading"], want["meter_reading"])


@pytest.mark.parametrize("limit", [1, LIMIT])
def test_expanding(df, limit):
    functions = ("mean", "std", "min", "max")
    plain = windows.add_expanding_features(df, functions=functions, split=False)
    assert_same(plain, windows.add_expanding_features(df, functions=functions, limit=limit))


def test_lags_match_pandas(df, frame):
    out = pandas_of(windows.add_lag_features(df, hours=(24,), limit=LIMIT))
    want = frame.sort_values(["building_id", "timestamp"], na_position="last")
    shifted = want.groupby(want["building_id"].fillna("?"), sort=False)["meter_reading"].shift(24)
    np.testing.assert_array_equal(out["meter_reading_lag_24h"], shifted.to_numpy())


def test_positions(df, frame):
    out = row_positions(df.repartition(9), ["building_id"], ["timestamp"]).toPandas()
    for _, part in out.sort_values("timestamp").groupby(out["building_id"].fillna("?")):
        assert part["__pos"].tolist() == list(range(len(part))) and set(part["__size"]) == {len(part)}


def test_quantiles(df, frame):
    probs = {"lo": 0.0, "a": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "b": 0.99, "hi": 1.0}
    out = grouped_stats(df, ["building_id"], [F.count("meter_reading").alias("n")], "meter_reading", probs, LIMIT)
    found = out.toPandas().set_index(out.toPandas()["building_id"].fillna("?"))
    for name, part in frame.groupby(frame["building_id"].fillna("?")):
        known = part["meter_reading"].dropna()
        assert found.loc[name, "n"] == len(known)
        np.testing.assert_allclose(found.loc[name, list(probs)].astype(float), np.quantile(known, list(probs.values())), rtol=1e-12)


def test_quantiles_of_skewed_and_repeated_values(spark):
    values = [0.0] * 500 + [1.0] * 3 + [1e12, -1e12] + list(np.exp(np.linspace(-20, 20, 400)))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    out = exact_quantiles(df, [], "v", {"p10": 0.1, "p50": 0.5, "p60": 0.6, "p999": 0.999}, limit=10).first()
    np.testing.assert_allclose(list(out), np.quantile(values, [0.1, 0.5, 0.6, 0.999]), rtol=1e-9)


def test_quantiles_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None)] * 30 + [("b", 1.0)] * 30, "k string, v double")
    rows = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}, limit=10).collect()}
    assert rows == {"a": None, "b": 1.0}
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("salt", [True, False])
def test_lookup_join(df, spark, how, salt):
    right = spark.createDataFrame([("hot", 1), ("small", 2), ("absent", 3), (None, 4)], "building_id string, x int")
    plain = df.join(right, "building_id", how).select("building_id", "timestamp", "meter_reading", "x")
    spread = lookup_join(df, right, ["building_id"], how, broadcast_rows=0, salt_hot=salt, limit=LIMIT)
    small = lookup_join(df, right, ["building_id"], how)
    for out in (spread, small):
        assert out.columns == plain.columns and sorted(out.collect(), key=str) == sorted(plain.collect(), key=str)


def test_lookup_join_spreads_hot_keys(df, spark):
    right = spark.createDataFrame([("hot", 1)], "building_id string, x int")
    out = lookup_join(df, right, ["building_id"], broadcast_rows=0, limit=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan


def test_exclusion(df, spark):
    gone = spark.createDataFrame([("hot",)], "building_id string")
    left = exclude_buildings(df, gone)
    assert left.columns == df.columns and left.count() == df.filter("building_id is null or building_id <> 'hot'").count()


@pytest.mark.parametrize("limit", [1, LIMIT])
def test_hourly_grid(df, frame, limit):
    out = windows.hourly_grid(df, limit=limit)
    found = out.toPandas()
    assert out.columns == df.columns and found["meter_reading"].notna().sum() == frame["meter_reading"].notna().sum()
    for name, part in frame.groupby(frame["building_id"].fillna("?")):
        hours = pd.date_range(part["timestamp"].min(), part["timestamp"].max(), freq="h")
        got = found[found["building_id"].fillna("?") == name].sort_values("timestamp")
        assert got["timestamp"].tolist() == hours.tolist()
        want = part.set_index("timestamp")["meter_reading"].reindex(hours)
        np.testing.assert_array_equal(got["meter_reading"].astype(float), want)


@pytest.mark.parametrize("size", [1, 2, 24, 168])
def test_block_merged_rolling_matches_frames(df, size, monkeypatch):
    wanted = ((size, ("mean", "std", "min", "max")),)
    monkeypatch.setattr(windows, "LONG_WINDOW", 10_000)
    frames = pandas_of(windows.add_rolling_features(df, windows=wanted, split=False))
    monkeypatch.setattr(windows, "LONG_WINDOW", 1)
    for limit, split in ((LIMIT, None), (1, None), (LIMIT, False)):
        blocks = pandas_of(windows.add_rolling_features(df, windows=wanted, limit=limit, split=split))
        pd.testing.assert_frame_equal(blocks[list(frames.columns)], frames, rtol=1e-9, atol=1e-6)
