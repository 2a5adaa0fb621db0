"""Estimators against numpy, and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.models import additive, boosted, cells, linear, regimes
from meterlake.models.metrics import evaluate
from meterlake.operators.splits import time_folds, time_split


@pytest.fixture(scope="module")
def rows(spark):
    """A target with a linear, a curved and a pairwise part, a missing feature value here and there."""
    return (
        spark.range(6000)
        .selectExpr(
            "id",
            "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) timestamp",
            "concat('c', case when id % 3 = 0 then 0 else id % 5 end) client",
            "double(pmod(hash(id, 1), 1000)) / 100 a",
            "double(pmod(hash(id, 2), 1000)) / 100 b",
            "case when id % 50 = 7 then null else double(pmod(hash(id, 3), 1000)) / 100 end c",
        )
        .withColumn("meter_reading", F.expr("20 + 2 * a + 3 * sin(b) + case when a > 5 and b > 5 then 8 else 0 end + coalesce(c, 30) / 10"))
        .persist()
    )


def brute(rows, features):
    pdf = rows.select(*features, "meter_reading").na.drop("any").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy()])
    return np.linalg.lstsq(x, pdf["meter_reading"].to_numpy(), rcond=None)[0], len(pdf)


def test_group_fits_match_numpy(rows):
    fitted = {r["client"]: r for r in linear.fit_groups(rows, ["a", "b", "c"], "meter_reading", "client").collect()}
    assert len(fitted) == 5
    for client, row in fitted.items():
        want, n = brute(rows.filter(F.col("client") == client), ["a", "b", "c"])
        np.testing.assert_allclose(row["coefficients"], want, rtol=1e-8)
        assert row["n"] == n


def test_partial_moments_are_merged_and_flushed(rows, monkeypatch):
    many = rows.withColumn("client", (F.col("id") % 700).cast("string")).repartition(2)
    names = ["a", "b", "meter_reading"]
    want = {k: g[names].to_numpy() for k, g in many.select("client", *names).toPandas().groupby("client")}
    for groups in (4096, 16):
        monkeypatch.setattr(linear, "_FLUSH_GROUPS", groups)
        found = {r["key"]: r for r in linear.co_moments(many, ["a", "b"], "meter_reading", "client").collect()}
        assert want.keys() == found.keys() and len(want) == 700
        for key, x in want.items():
            centred = x - x.mean(axis=0)
            np.testing.assert_allclose(found[key]["mean"], x.mean(axis=0))
            np.testing.assert_allclose(found[key]["c"], (centred.T @ centred)[np.triu_indices(3)], atol=1e-9)
            assert found[key]["n"] == len(x)


def test_twenty_features_far_from_zero_match_a_qr_solution(spark):
    """Years near 2016, square feet and 0/1 columns: raw sums of products would lose eight and more digits here."""
    pick = np.random.default_rng(11)
    n = 5000
    x = np.column_stack([
        2016 + pick.integers(0, 2, n), 1950 + pick.integers(0, 70, n), *(1e5 * (1 + 1e-3 * pick.random((4, n)))),
        *(pick.random((8, n)) < 0.3), *(1e7 + pick.normal(size=(3, n))), *pick.normal(size=(3, n)),
    ]).astype(float)
    y = x @ pick.normal(size=20) + 1e6 + pick.normal(size=n)
    names = [f"x{i}" for i in range(20)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])).repartition(13).withColumn("k", F.lit("all"))
    row = linear.fit_groups(df, names, "y", "k").first()
    centre = x.mean(axis=0)
    q, r = np.linalg.qr(x - centre)
    slopes = np.linalg.solve(r, q.T @ (y - y.mean()))
    np.testing.assert_allclose(row["coefficients"][1:], slopes, rtol=1e-8)
    np.testing.assert_allclose(row["coefficients"][0], y.mean() - centre @ slopes, rtol=1e-8)


def test_columns_that_do_not_vary_get_no_slope(spark):
    df = spark.createDataFrame([("k", 5.0, float(i), 3.0 * i + 2) for i in range(10)], "k string, a double, b double, y double")
    np.testing.assert_allclose(linear.fit_groups(df, ["a", "b"], "y", "k").first()["coefficients"], [2, 0, 3], atol=1e-9)
    one = linear.fit_groups(df.limit(1), ["a", "b"], "y", "k").first()
    assert one["n"] == 1 and one["coefficients"][1:] == [0, 0]
    assert linear.fit_groups(df.limit(0), ["a", "b"], "y", "k").count() == 0


def test_unseen_client_has_no_prediction(rows):
    models = linear.fit_groups(rows.filter("client <> 'c1'"), ["a"], "meter_reading", "client")
    out = linear.predict_groups(rows, models, ["a"], "client")
    assert out.filter("prediction is null").select("client").distinct().collect() == [("c1",)]


def test_standardise(rows):
    out = linear.standardise(rows.withColumn("k", F.lit(3.0)), ["a", "k"]).agg(F.avg("a"), F.stddev_samp("a"), F.max("k")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1) and out[2] == 0


def test_client_sampling(rows):
    drawn = linear.sample_clients(rows, "client", 3, 0.5, seed=1)
    assert {r["round"]: r["count"] for r in drawn.groupBy("round").count().collect()} == {1: 2, 2: 2, 3: 2}
    assert linear.sample_clients(rows, "client", 1, 0.01).count() == 1


def test_ridge_grid_matches_refits(rows):
    folds = time_folds(rows, 2)
    found = {(r["fold"], r["alpha"]): r for r in linear.tune_ridge(rows, ["a", "b"], "meter_reading", folds, (0.0, 10.0)).collect()}
    fold = folds.filter("fold = 2").first()
    month = F.year("timestamp") * 12 + F.month("timestamp") - 1
    train = rows.filter(month.between(fold["train_from"], fold["train_to"]))
    test = rows.filter(month.between(fold["test_from"], fold["test_to"]))
    want, n = brute(train, ["a", "b"])
    scored = test.withColumn("p", F.lit(float(want[0])) + F.col("a") * float(want[1]) + F.col("b") * float(want[2]))
    row = found[(2, 0.0)]
    assert row["rmse"] == pytest.approx(evaluate(scored, "meter_reading", "p").first()["rmse"], rel=1e-6)
    assert row["train_rows"] == n and row["test_rows"] == test.count() and len(found) == 4


def test_regimes(rows):
    train, test = time_split(rows)
    out = {r["regime"]: r for r in regimes.compare_regimes(train, test, ["a", "b"], "meter_reading", "client").collect()}
    assert set(out) == {"per_site", "centralized", "federated"} and all(r["r2"] > 0.5 for r in out.values())


def test_additive_model(spark, rows, tmp_path):
    train, test = time_split(rows)
    model = additive.fit_additive(train, ["a", "b", "c"], interactions=1, penalty=1e-6)
    assert model.pairs == [("a", "b")]
    scored = model.predict(test)
    assert evaluate(scored, "meter_reading", "prediction").first()["r2"] > 0.98
    total = model.explain_local(test, ["id"]).groupBy("id").agg(F.sum("contribution").alias("total"))
    assert scored.join(total, "id").filter("abs(prediction - total) > 1e-9").count() == 0
    weighted = model.shape_table(spark).groupBy("term").agg(F.sum(F.col("contribution") * F.col("rows")).alias("w"))
    assert weighted.filter("abs(w) > 1e-6").count() == 0
    assert model.explain_global(spark).first()["term"] in ("a", "a x b")
    model.save(spark, str(tmp_path / "m"))
    again = additive.AdditiveModel.load(spark, str(tmp_path / "m")).predict(test)
    assert again.join(scored.select("id", F.col("prediction").alias("q")), "id").filter("prediction <> q").count() == 0


def test_additive_sums_match_brute_force(rows):
    edges = additive.quantile_edges(rows, ["a", "c"], 8)
    binned = additive.bin_features(rows, ["a", "c"], edges)
    terms = {f: (F.col(f"__bin_{f}"), len(edges[f]) + 2) for f in ("a", "c")}
    gram, sums = additive.normal_sums(binned, "meter_reading", terms)
    pdf = binned.toPandas()
    sizes = [len(edges[f]) + 2 for f in ("a", "c")]
    x = np.hstack([np.eye(s)[pdf[f"__bin_{f}"].astype(int)] for f, s in zip(("a", "c"), sizes)])
    np.testing.assert_allclose(gram, x.T @ x)
    np.testing.assert_allclose(sums, x.T @ pdf["meter_reading"].to_numpy())
    missing = np.flatnonzero(pdf["c"].isna())
    assert set(pdf["__bin_c"].iloc[missing]) == {float(sizes[1] - 1)}


def test_additive_beyond_the_dense_bound(rows, monkeypatch):
    features = ["a", "b", "c"]
    whole = additive.fit_additive(rows, features, bins=256, interactions=1)
    monkeypatch.setattr(additive, "DENSE_BINS", 10)
    monkeypatch.setattr(additive, "PASS_CELLS", 1000)
    parts = additive.fit_additive(rows, features, bins=256, interactions=1)
    assert parts.pairs == whole.pairs and parts.weights == whole.weights
    for term, values in {**whole.shapes, **whole.pair_shapes}.items():
        assert {**parts.shapes, **parts.pair_shapes}[term] == pytest.approx(values, abs=1e-5)


def test_additive_with_constant_feature(rows):
    model = additive.fit_additive(rows.withColumn("k", F.lit(1.0)), ["a", "k"], interactions=0)
    assert model.predict(rows.withColumn("k", F.lit(1.0))).filter("prediction is null").count() == 0


def test_boosted_trees(spark, rows, tmp_path):
    train, test = time_split(rows)
    model = boosted.fit_boosted(train, ["a", "b", "c"], maxIter=40, stepSize=0.2)
    boosted.save_model(model, str(tmp_path / "m"))
    scored = boosted.predict_boosted(boosted.load_model(str(tmp_path / "m")), test, ["a", "b", "c"])
    assert scored.columns == [*test.columns, "prediction"] and scored.filter("c is null").count() > 0
    assert evaluate(scored, "meter_reading", "prediction").first()["r2"] > 0.9
    ranked = boosted.importances(model, spark).collect()
    assert ranked[0]["feature"] == "a" and ranked[0]["importance"] > ranked[-1]["importance"] > 0
    assert sum(r["splits"] for r in ranked) == boosted.node_table(model, spark).count()


def test_best_stage_waits_for_its_patience():
    errors = [9.0, 8.0, 8.5, 8.4, 8.3, 1.0, 2.0]
    assert [boosted.best_stage(errors, p) for p in (1, 3, 4, 50)] == [2, 2, 6, 6]
    assert boosted.best_stage([1.0]) == 1 and boosted.best_stage([2.0, 2.0, 2.0]) == 1


def test_trees_are_cut_back_to_the_best_stage(spark, rows, tmp_path):
    """The newest rows turn around, so that every further tree hurts there."""
    turned = rows.withColumn("meter_reading", F.when(F.col("id") >= 5400, -F.col("a")).otherwise(F.col("a") + F.col("b"))).filter("id < 6000")
    model = boosted.fit_boosted(turned, ["a", "b"], maxIter=12, maxDepth=2, stepSize=0.5, patience=4)
    every = boosted.fit_boosted(turned.filter("id < 5400"), ["a", "b"], validation_share=None, maxIter=12, maxDepth=2, stepSize=0.5)
    held = turned.filter("id >= 5400")
    errors = boosted.stage_errors(every, boosted.with_missing_marker(held, ["a", "b"]))
    kept = boosted.best_stage(errors, 4)
    assert model.stages[-1].getNumTrees == kept < 12
    boosted.save_model(model, str(tmp_path / "cut"))
    scored = boosted.predict_boosted(boosted.load_model(str(tmp_path / "cut")), held, ["a", "b"])
    assert scored.agg(F.avg(F.pow(F.col("prediction") - F.col("meter_reading"), 2))).first()[0] == pytest.approx(errors[kept - 1])
    assert set(boosted.node_table(model, spark).agg(F.max("tree")).first()) <= {kept - 1, *range(kept)}


def test_gains_of_one_stump_are_its_loss_of_squared_error(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 5), 10.0 * (i % 2) + i % 3) for i in range(60)], "a double, b double, meter_reading double")
    model = boosted.fit_boosted(df, ["a", "b"], validation_share=None, maxIter=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all")
    got = {r["feature"]: (r["importance"], r["splits"]) for r in boosted.importances(model, spark).collect()}
    y = np.array([10.0 * (i % 2) + i % 3 for i in range(60)])
    loss = ((y - y.mean()) ** 2).sum() - sum(((y[k::2] - y[k::2].mean()) ** 2).sum() for k in (0, 1))
    assert got["a"] == (pytest.approx(loss), 1) and got["b"] == (0.0, 0)


def _noisy(spark, count=6000):
    rows = spark.range(0, count, 1, 3).select("id", F.rand(1).alias("a"), F.floor(F.rand(2) * 9).cast("double").alias("b"), F.randn(3).alias("c"), F.randn(4).alias("d"))
    value = F.sin(F.col("a") * 6) * 100 + F.col("b") ** 2 + F.when(F.col("c") > 0, F.col("d") * 9).otherwise(0) + F.randn(5)
    return rows.withColumn("meter_reading", value).withColumn("c", F.when(F.col("id") % 11 > 0, F.col("c")))


@pytest.mark.parametrize(
    "params",
    [{"maxIter": 5}, {"maxIter": 3, "featureSubsetStrategy": "0.5", "maxBins": 9, "minInstancesPerNode": 50, "maxDepth": 6}, {"maxIter": 3, "subsamplingRate": 1.0, "maxBins": 8}],
)
def test_trees_over_cells_are_the_librarys(spark, monkeypatch, params):
    rows, names = _noisy(spark), ["a", "b", "c", "d"]
    found = []
    for most in (cells.MOST_CELLS, 3):
        monkeypatch.setattr(cells, "MOST_CELLS", most)
        model = boosted.fit_boosted(rows, names, validation_share=None, **params)
        nodes = boosted.node_table(model, spark).orderBy("tree", "node").collect()
        scores = [r.prediction for r in boosted.predict_boosted(model, rows, names).orderBy("id").collect()]
        found.append(([tuple(r)[:5] for r in nodes], [r.gain for r in nodes], scores))
    assert found[0][0] == found[1][0] and len(found[0][0]) > 40
    assert found[0][1] == pytest.approx(found[1][1]) and found[0][2] == pytest.approx(found[1][2])


def test_rows_are_read_a_few_times_for_any_number_of_trees(spark):
    rows, context = _noisy(spark, 2000), spark.sparkContext
    jobs = []
    for count in (2, 30):
        context.setJobGroup(f"trees-{count}", "trees")
        model = boosted.fit_boosted(rows, ["a", "b"], validation_share=None, maxIter=count)
        assert model.stages[-1].getNumTrees == count
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"trees-{count}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 15


def test_features_that_are_no_number_are_refused(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0)], "a double, meter_reading double")
    with pytest.raises(Exception, match="NaN"):
        boosted.fit_boosted(rows, ["a"], validation_share=None, maxIter=1)


@pytest.mark.parametrize("name", ["scored_models", "tree_importances"])
def test_tree_queries_read_their_rows_a_few_times(spark, tmp_path, name):
    import __spark_entry__ as entry

    number = F.col("id")
    spark.range(0, 1500, 1, 2).select(
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 300))").alias("l_shipdate"), (number % 7).alias("l_suppkey"), number.alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"), F.floor(F.rand(1) * 50).cast("double").alias("l_quantity"), F.round(F.rand(2) / 10, 2).alias("l_discount"),
        F.round(F.rand(3) / 12, 2).alias("l_tax"), (F.rand(4) * 1000 + number % 50).alias("l_extendedprice"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    context = spark.sparkContext
    context.setJobGroup(f"query-{name}", name)
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup(f"query-{name}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == (5 if name == "tree_importances" else 300)
    assert jobs < 200, "a hundred trees of five levels took several hundred"
