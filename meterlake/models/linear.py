"""Ridge regression from co-moments: whole table, per client, per fold.

A group's least-squares problem is fully described by its row count, the means of its columns and their centred cross
products. Those are computed per input batch with numpy and merged on the cluster, so no group's rows ever meet in one
task, and columns far from zero (years, square feet) lose no digits as they would in raw sums of products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..operators.splits import seeded_key
from ..session import cut_lineage

_FLUSH_GROUPS = 4096
_BUCKETS = 64
_MOMENTS = "key string, n long, mean array<double>, c array<double>"


def standardise(df: DataFrame, features: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """Features as (x - mean) / std over the table (or the one-row ``moments``); constant features become 0."""
    if moments is None:
        moments = feature_moments(df, features)
    row = moments.first()
    return df.withColumns(
        {
            f: (F.col(f) - F.lit(row[f"{f}_mean"])) / F.lit(row[f"{f}_std"]) if row[f"{f}_std"] else F.col(f) * 0.0
            for f in features
        }
    )


def feature_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.avg(f).alias(f"{f}_mean") for f in features], *[F.stddev_samp(f).alias(f"{f}_std") for f in features]
    )


def co_moments(df: DataFrame, features: Sequence[str], target: str, key: str) -> DataFrame:
    """(key, n, mean, c): rows, means of (features..., target) and the upper triangle of their centred cross products.

    Rows with a NULL are left out. Each input batch is centred on its own means; batches, tasks and at last buckets of
    tasks are merged in turn (see _combine), each merge holding one matrix per key of its rows. Only matrices are shuffled.
    """
    names = [*features, target]
    complete = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in names])
    complete = complete.na.drop("any")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[_Moments] = []
        for batch in batches:
            if not len(batch):
                continue
            x = batch[names].to_numpy(dtype=float)
            rows = _Moments(batch["key"].to_numpy(dtype=object), np.ones(len(x)), x, None)
            held.append(_combine([rows]))
            if sum(len(m.keys) for m in held) > _FLUSH_GROUPS:
                held = [_combine(held)]
                if len(held[0].keys) > _FLUSH_GROUPS // 2:
                    yield _frame(held.pop())
        if held:
            yield _frame(_combine(held))

    parts = complete.mapInPandas(partial, _MOMENTS)
    return merged_moments(parts.withColumn("bucket", F.spark_partition_id() % _BUCKETS), "key", "bucket")


def merged_moments(parts: DataFrame, key: str, bucket: str | None = None) -> DataFrame:
    """Partial moments (key, n, mean, c) merged into one row per key, first within each bucket of a key if there are any.

    Rows come in the order of the key, so a task holds one batch and the key at its end.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            if len(frame):
                now = _combine([m for m in (last, _moments(frame)) if m is not None])
                at = np.flatnonzero(now.keys == frame["key"].iloc[-1])[0]
                ready = np.arange(len(now.keys)) != at
                last = now.take([at])
                if ready.any():
                    yield _frame(now.take(ready))
        if last is not None:
            yield _frame(last)

    rows = parts.withColumn("key", F.col(key).cast("string"))
    for by in (["key", bucket], ["key"]) if bucket else (["key"],):
        kept = rows.select("key", "n", "mean", "c", *([bucket] if bucket in by else []))
        rows = kept.repartition(*by).sortWithinPartitions(*by).select("key", "n", "mean", "c").mapInPandas(fold, _MOMENTS)
    return rows


class _Moments(NamedTuple):
    """Co-moments of several keys; c is None for single rows."""

    keys: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    c: np.ndarray | None

    def take(self, at) -> _Moments:
        return _Moments(self.keys[at], self.n[at], self.mean[at], self.c[at])


def _combine(parts: Sequence[_Moments]) -> _Moments:
    """One entry per key. The parts' cross products are about their own means, so each adds n d dᵀ, with d the distance of
    its mean from the common one: no large sums cancel, wherever the columns lie."""
    keys, code = np.unique(np.concatenate([m.keys for m in parts]), return_inverse=True)
    n_part, mean_part = np.concatenate([m.n for m in parts]), np.concatenate([m.mean for m in parts])
    n = np.bincount(code, n_part, len(keys))
    size = mean_part.shape[1]
    # About the first part's mean of each key, so that far-off means lose nothing either.
    base = np.zeros((len(keys), size))
    base[code[::-1]] = mean_part[::-1]
    away = mean_part - base[code]
    shift = np.column_stack([np.bincount(code, n_part * away[:, i], len(keys)) for i in range(size)]) / n[:, None]
    d = away - shift[code]
    c = np.column_stack([np.bincount(code, n_part * d[:, i] * d[:, j], len(keys)) for i in range(size) for j in range(i, size)])
    own = [m.c for m in parts if m.c is not None]
    if own:
        np.add.at(c, code, np.concatenate(own))
    return _Moments(keys, n, base + shift, c)


def _frame(m: _Moments) -> pd.DataFrame:
    return pd.DataFrame({"key": m.keys, "n": m.n.astype(np.int64), "mean": list(m.mean), "c": list(m.c)})


def _moments(frame: pd.DataFrame) -> _Moments:
    return _Moments(frame["key"].to_numpy(dtype=object), frame["n"].to_numpy(dtype=float), np.stack(frame["mean"]), np.stack(frame["c"]))


def _square(triangle: np.ndarray) -> np.ndarray:
    """The full symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * triangle.size + 1) - 1) / 2)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = triangle
    return m + np.triu(m, 1).T


def _solve(mean: np.ndarray, triangle: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge solution of one set of co-moments, the intercept (not penalised) first.

    Columns are scaled to equal size for solving; a column that doesn't vary gets 0.
    """
    m = _square(triangle)
    a, b = m[:-1, :-1].copy(), m[:-1, -1]
    a[np.diag_indices_from(a)] += penalty
    scale = np.sqrt(np.diag(a))
    scale = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    slopes = scale * np.linalg.lstsq(a * np.outer(scale, scale), b * scale, rcond=None)[0]
    return np.concatenate([[mean[-1] - mean[:-1] @ slopes], slopes])


def _squared_error(n: float, mean: np.ndarray, triangle: np.ndarray, coefficients: np.ndarray) -> float:
    """Sum of squared residuals of a solution over the rows that the co-moments stand for."""
    z = np.append(-coefficients[1:], 1.0)
    return max(float(z @ _square(triangle) @ z + n * (mean @ z - coefficients[0]) ** 2), 0.0)


def fit_groups(
    df: DataFrame, features: Sequence[str], target: str, client: str, penalty: float = 0.0
) -> DataFrame:
    """One local model per client: (client, n, coefficients), coefficients[0] being the intercept."""

    @F.pandas_udf("array<double>")
    def solve(mean: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_solve(m, x, penalty) for m, x in zip(mean, c)])

    fitted = co_moments(df, features, target, client)
    return fitted.select(F.col("key").alias(client), "n", solve("mean", "c").alias("coefficients"))


def linear_prediction(features: Sequence[str], coefficients: Column) -> Column:
    terms = F.get(coefficients, F.lit(0))
    for i, f in enumerate(features, 1):
        terms = terms + F.get(coefficients, F.lit(i)) * F.col(f)
    return terms


def predict_groups(
    df: DataFrame, models: DataFrame, features: Sequence[str], client: str, name: str = "prediction"
) -> DataFrame:
    """Each row by its client's model; NULL for a client without one."""
    right = models.select(F.col(client).alias("__client"), F.col("coefficients").alias("__coef"))
    keyed = df.withColumn("__client", F.col(client).cast("string"))
    joined = lookup_join(keyed, right, ["__client"])
    return joined.select(*df.columns, linear_prediction(features, F.col("__coef")).alias(name))


def average_models(models: DataFrame, weighted: bool = True) -> DataFrame:
    """One global coefficient vector: the mean over clients, weighted by their rows."""
    weight = F.col("n").cast("double") if weighted else F.lit(1.0)
    cells = models.select(weight.alias("w"), F.posexplode("coefficients").alias("pos", "c"))
    means = cells.groupBy("pos").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "c")))
    return means.agg(F.transform(ordered, lambda x: x["c"]).alias("coefficients"))


def sample_clients(df: DataFrame, client: str, rounds: int = 5, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """(round, client): max(1, floor(n * fraction)) clients per round, in seeded order."""
    clients = df.select(client).filter(F.col(client).isNotNull()).distinct()
    drawn = clients.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = drawn.withColumn("__key", seeded_key([client, "round"], seed))
    per_round = Window.partitionBy("round")
    ranked = drawn.select(
        "round",
        client,
        F.row_number().over(per_round.orderBy("__key")).alias("__r"),
        F.count(F.lit(1)).over(per_round).alias("__n"),
    )
    quota = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))
    return ranked.filter(F.col("__r") <= quota).select("round", client)


def round_summary(chosen: DataFrame, client_metrics: DataFrame, client: str) -> DataFrame:
    """Unweighted mean of the chosen clients' RMSLE per round."""
    joined = chosen.withColumn(client, F.col(client).cast("string")).join(
        client_metrics.withColumn(client, F.col(client).cast("string")), client
    )
    return joined.groupBy("round").agg(F.avg("rmsle").alias("avg_rmsle"), F.count(F.lit(1)).alias("clients"))


def averaged_rounds(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    client: str,
    rounds: int = 10,
    fraction: float = 0.5,
    penalty: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """(round, clients, coefficients): the weighted average of each round's chosen clients.

    A ridge solution does not depend on a starting point, so all local models are fitted once; the rounds differ in the
    clients they draw.
    """
    models = cut_lineage(fit_groups(df, features, target, client, penalty))
    chosen = sample_clients(models, client, rounds, fraction, seed)
    drawn = models.join(chosen, client)
    cells = drawn.select("round", client, "n", F.posexplode("coefficients").alias("pos", "c"))
    means = cells.groupBy("round", "pos").agg(
        (F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("c"), F.count(F.lit(1)).alias("clients")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "c")))
    return means.groupBy("round").agg(
        F.max("clients").alias("clients"), F.transform(ordered, lambda x: x["c"]).alias("coefficients")
    )


def tune_ridge(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    folds: DataFrame,
    alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0),
    time_col: str = "timestamp",
) -> DataFrame:
    """(fold, alpha, train_rows, test_rows, rmse) for the whole grid from one pass over the rows.

    Co-moments per month are merged into each fold's train and test ones; the squared error of a solution follows from the
    test ones alone.
    """
    month = F.year(time_col) * 12 + F.month(time_col) - 1
    monthly = co_moments(df.withColumn("__month", month), features, target, "__month")
    monthly = cut_lineage(monthly.withColumn("month", F.col("key").cast("int")).drop("key"))

    def of(role: str) -> DataFrame:
        ranges = folds.select("fold", f"{role}_from", f"{role}_to")
        inside = F.col("month").between(F.col(f"{role}_from"), F.col(f"{role}_to"))
        whole = merged_moments(monthly.join(F.broadcast(ranges), inside), "fold")
        return whole.select(F.col("key").cast("int").alias("fold"), F.struct("n", "mean", "c").alias(role))

    pairs = of("train").join(of("test"), "fold")
    pairs = pairs.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))

    @F.pandas_udf("double")
    def test_sse(mean: pd.Series, c: pd.Series, n: pd.Series, test_mean: pd.Series, test_c: pd.Series, alpha: pd.Series) -> pd.Series:
        fits = (_solve(m, x, a) for m, x, a in zip(mean, c, alpha))
        return pd.Series([_squared_error(k, m, x, w) for k, m, x, w in zip(n, test_mean, test_c, fits)])

    rows = F.col("test.n")
    return pairs.select(
        "fold",
        "alpha",
        F.col("train.n").alias("train_rows"),
        rows.alias("test_rows"),
        F.sqrt(test_sse("train.mean", "train.c", "test.n", "test.mean", "test.c", "alpha") / rows).alias("rmse"),
    )
