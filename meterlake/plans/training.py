"""Train, score and compare the models on a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.additive import fit_additive
from ..models.boosted import fit_boosted, importances, predict_boosted, save_model
from ..models.linear import fit_groups, predict_groups, round_summary, sample_clients
from ..models.metrics import evaluate
from ..operators.features import feature_columns
from ..operators.splits import mark_client_split, seeded_sample, time_split
from ..session import cut_lineage
from ..sources.files import export_scored, write_parquet

TARGET = "meter_reading"


def client_round_metrics(
    df: DataFrame, features: list[str], client: str = "site_id", rounds: int = 2, fraction: float = 1.0, penalty: float = 1.0
) -> DataFrame:
    """Average validation RMSLE per round of the clients drawn in it, each with its own model."""
    rows = df.filter(F.col(TARGET).isNotNull()).na.fill(0.0, features)
    marked = mark_client_split(rows, client, ["timestamp", "building_id"])
    models = cut_lineage(fit_groups(marked.filter("is_train"), features, TARGET, client, penalty))
    scored = predict_groups(marked.filter("not is_train"), models, features, client)
    return round_summary(sample_clients(rows, client, rounds, fraction), evaluate(scored, TARGET, "prediction", [client]), client)


def score_models(df: DataFrame, sample_rows: int | None = None, keys=("building_id", "timestamp"), **trees) -> dict:
    """Split by time, fit trees and the additive model, and score the test rows with both.

    The additive model is trained on all rows, or on a seeded sample of ``sample_rows`` of them.
    """
    features = feature_columns(df)
    train, test = time_split(df)
    boosted = fit_boosted(train, features, TARGET, **trees)
    subset = train if sample_rows is None else seeded_sample(train, list(keys), sample_rows)
    additive = fit_additive(subset, features, TARGET)
    scored = predict_boosted(boosted, test, features, "predicted_trees")
    scored = additive.predict(scored, "predicted_additive").withColumnRenamed(TARGET, "actual")
    return {"features": features, "boosted": boosted, "additive": additive, "scored": scored}


def run_training(spark: SparkSession, features_path: str, out_dir: str, **options) -> DataFrame:
    """Feature table in; models, scored rows and a metrics table out."""
    df = spark.read.parquet(features_path)
    result = score_models(df, **options)
    save_model(result["boosted"], f"{out_dir}/models/trees")
    result["additive"].save(spark, f"{out_dir}/models/additive")
    write_parquet(result["scored"], f"{out_dir}/scored")
    scored = spark.read.parquet(f"{out_dir}/scored")
    export_scored(scored.select("building_id", "timestamp", "actual", "predicted_trees", "predicted_additive"), f"{out_dir}/scored_csv")
    write_parquet(importances(result["boosted"], spark), f"{out_dir}/importances")
    metrics = evaluate(scored, "actual", "predicted_trees").withColumn("model", F.lit("trees")).unionByName(
        evaluate(scored, "actual", "predicted_additive").withColumn("model", F.lit("additive"))
    )
    write_parquet(metrics, f"{out_dir}/metrics")
    return spark.read.parquet(f"{out_dir}/metrics")
