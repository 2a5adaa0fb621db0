"""Gradient-boosted regression trees on Spark ML, their importances, and grid search over time folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ntz_literal
from ..operators.splits import split_time
from ..session import scratch_path, shared_dir
from .cells import fit_over_cells
from .tuning import tune_over_folds

# Stands for a missing feature value: below every real one, so trees can split it off.
MISSING = -1.0e9


def with_missing_marker(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features})


def default_trees(target: str, **params) -> GBTRegressor:
    settings = dict(
        maxIter=100,
        stepSize=0.05,
        maxDepth=5,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.9",
        seed=42,
        checkpointInterval=10,
    )
    return GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", **{**settings, **params})


def fit_boosted(
    train: DataFrame,
    features: Sequence[str],
    target: str = "meter_reading",
    validation_share: float | None = 0.1,
    time_col: str = "timestamp",
    patience: int = 50,
    **params,
) -> PipelineModel:
    """Trees on the training rows, cut back to the best stage.

    The newest ``validation_share`` of the training hours is held out; all stages are evaluated on it, and the ensemble
    ends at the best one before ``patience`` rounds without gain. Without a share, every tree is kept and no row held out.
    """
    shared_dir(train.sparkSession)
    rows, held = with_missing_marker(train.filter(F.col(target).isNotNull()), features), None
    if validation_share:
        found = split_time(train, 1.0 - validation_share, time_col).first()
        newest = F.coalesce(F.col(time_col) >= ntz_literal(None if found is None else found[0]), F.lit(False))
        rows, held = rows.filter(~newest), rows.filter(newest)
    assembler, trees = VectorAssembler(inputCols=list(features), outputCol="features"), default_trees(target, **params)
    model = fit_over_cells(assembler, trees, rows) or Pipeline(stages=[assembler, trees]).fit(rows)
    if held is None or held.isEmpty():
        return model
    return first_trees(model, best_stage(stage_errors(model, held), patience))


def stage_errors(model: PipelineModel, rows: DataFrame) -> list[float]:
    """Mean squared error on the rows after each tree, from one pass over them."""
    assembler, trees = model.stages
    return list(trees.evaluateEachIteration(assembler.transform(rows), "squared"))


def best_stage(errors: Sequence[float], patience: int = 50) -> int:
    """Number of trees at the smallest error, looking no further once ``patience`` trees brought no smaller one."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        if i - best >= patience:
            break
    return best + 1


def first_trees(model: PipelineModel, count: int) -> PipelineModel:
    """The ensemble of the first ``count`` trees."""
    assembler, trees = model.stages
    if count >= trees.getNumTrees:
        return model
    gateway, java = SparkSession.active().sparkContext._gateway, trees._java_obj
    kind = gateway.jvm.org.apache.spark.ml.regression
    kept, weights = gateway.new_array(kind.DecisionTreeRegressionModel, count), gateway.new_array(gateway.jvm.double, count)
    for i in range(count):
        kept[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = GBTRegressionModel(kind.GBTRegressionModel(java.uid(), kept, weights, trees.numFeatures))
    cut.setFeaturesCol(trees.getFeaturesCol()).setPredictionCol(trees.getPredictionCol())
    return PipelineModel([assembler, cut])


def predict_boosted(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """The rows with a prediction column; features keep their NULLs."""
    copies = {f: f"__f_{f}" for f in features}
    marked = df.withColumns({copies[f]: F.col(f) for f in features})
    scored = model.transform(with_missing_marker(marked, features))
    kept = [F.col(copies.get(c, c)).alias(c) for c in df.columns]
    return scored.select(*kept, F.col("prediction").alias(name))


def node_table(model: PipelineModel, spark) -> DataFrame:
    """One row for each split of each tree: tree, node, feature, threshold, rows and gain (of squared error).

    Spark fits the trees after the first to twice the residuals, whose squares count four times.
    """
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    names = F.array(*[F.lit(n) for n in model.stages[0].getInputCols()])
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*").filter("leftChild >= 0")
    gain = F.col("gain") * F.col("rawCount") / F.when(F.col("tree") == 0, 1.0).otherwise(4.0)
    return nodes.select(
        "tree", F.col("id").alias("node"), F.get(names, F.col("split.featureIndex")).alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("rawCount").alias("rows"), gain.alias("gain"),
    )


def importances(model: PipelineModel, spark) -> DataFrame:
    """Gain of squared error over all splits on each feature (0 for one never split on), and the splits, largest first."""
    every = spark.createDataFrame([(n,) for n in model.stages[0].getInputCols()], "feature string")
    found = node_table(model, spark).groupBy("feature").agg(F.sum("gain").alias("importance"), F.count(F.lit(1)).alias("splits"))
    return every.join(found, "feature", "left").na.fill(0).orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tune_boosted(
    df: DataFrame, features: Sequence[str], folds: DataFrame, grid: Sequence[dict], target: str = "meter_reading"
) -> DataFrame:
    """Metrics of the trees per fold and parameter set."""

    def scored(train: DataFrame, test: DataFrame, params: dict) -> DataFrame:
        return predict_boosted(fit_boosted(train, features, target, None, **params), test, features)

    return tune_over_folds(df, folds, grid, scored, target)
