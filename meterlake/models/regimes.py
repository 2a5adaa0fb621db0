"""Per-site, pooled and averaged training compared on the same test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .linear import average_models, fit_groups, linear_prediction, predict_groups
from .metrics import metric_columns


def compare_regimes(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, client: str, penalty: float = 1.0
) -> DataFrame:
    """(regime, metrics) for one model per client, one model over all rows, and the weighted average of the clients' models.

    The test rows are read once: each gets the three predictions, and these are scored together.
    """
    local = cut_lineage(fit_groups(train, features, target, client, penalty))
    pooled = fit_groups(train.withColumn("__pool", F.lit("all")), features, target, "__pool", penalty)
    pooled_coef = pooled.select("coefficients").scalar()
    average_coef = average_models(local).scalar()
    scored = predict_groups(test, local, features, client, "per_site")
    scored = scored.withColumns(
        {"centralized": linear_prediction(features, pooled_coef), "federated": linear_prediction(features, average_coef)}
    )
    tall = scored.select(
        F.col(target).alias("actual"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r).alias("regime"), F.col(r).alias("prediction"))
                    for r in ("per_site", "centralized", "federated")
                ]
            )
        ).alias("r"),
    ).select("actual", "r.*")
    both = tall.filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    return both.groupBy("regime").agg(*metric_columns(F.col("actual"), F.col("prediction")))
