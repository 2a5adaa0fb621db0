"""Explainable additive regression: one shape function per feature plus a few pairwise ones.

Features are cut at training quantiles; every (feature, bin) gets a contribution, fitted jointly by ridge regression on the
one-hot bins. Pairs are ranked by how much of the remaining error their cell means explain, and the best are fitted along
with the features. A prediction is the intercept plus the contributions, each of which can be read off a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tuning import tune_over_folds

#: Cells of co-occurring bins that a task counts at a time (8 bytes each); more take further passes over the rows.
PASS_CELLS = 8_000_000
#: Up to so many bins the driver solves the whole system (their square times 8 bytes); beyond, the cluster multiplies.
DENSE_BINS = 2_000


@dataclass
class AdditiveModel:
    """Cut points and contributions; all of it is small: features x bins numbers, and pairs x cells."""

    features: list[str]
    edges: dict[str, list[float]]
    intercept: float
    shapes: dict[str, list[float]]
    pairs: list[tuple[str, str]]
    pair_bins: int
    pair_shapes: dict[str, list[float]]
    weights: dict[str, list[float]]

    def contributions(self) -> dict[str, Column]:
        """One column per term, over a frame with bin columns."""
        out = {f: _pick(self.shapes[f], F.col(f"__bin_{f}")) for f in self.features}
        for a, b in self.pairs:
            cell = _cell(self.edges, a, b, self.pair_bins)
            out[f"{a} x {b}"] = _pick(self.pair_shapes[f"{a} x {b}"], cell)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        binned = bin_features(df, self.features, self.edges)
        total = F.lit(self.intercept)
        for column in self.contributions().values():
            total = total + column
        return binned.select(*df.columns, total.alias(name))

    def explain_local(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, term, contribution) per row; with the intercept they sum to the prediction."""
        binned = bin_features(df, self.features, self.edges)
        terms = {"intercept": F.lit(self.intercept), **self.contributions()}
        pairs = F.array(*[F.struct(F.lit(t).alias("term"), c.alias("contribution")) for t, c in terms.items()])
        return binned.select(*keys, F.explode(pairs).alias("t")).select(*keys, "t.*")

    def shape_table(self, spark: SparkSession) -> DataFrame:
        """(term, bin, contribution, rows): the shape functions, with the training rows behind each bin."""
        rows = [
            (term, i, float(v), float(w))
            for term, values in {**self.shapes, **self.pair_shapes}.items()
            for i, (v, w) in enumerate(zip(values, self.weights[term]))
        ]
        return spark.createDataFrame(rows, "term string, bin int, contribution double, rows double")

    def explain_global(self, spark: SparkSession) -> DataFrame:
        """Importance per term: the mean absolute contribution over the training rows."""
        size = F.col("contribution")
        return (
            self.shape_table(spark)
            .groupBy("term")
            .agg((F.sum(F.abs(size) * F.col("rows")) / F.sum("rows")).alias("importance"))
            .orderBy(F.desc("importance"), "term")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AdditiveModel":
        fields = json.loads(spark.read.text(path).first()[0])
        fields["pairs"] = [tuple(p) for p in fields["pairs"]]
        return AdditiveModel(**fields)


def _pick(values: Sequence[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), index.cast("int"))


def _coarse(edges: dict[str, list[float]], feature: str, bins: int) -> Column:
    """A bin number of the pair grid: quantile bins merged to ``bins`` groups, missing values last."""
    fine = len(edges[feature]) + 1
    at = F.col(f"__bin_{feature}")
    return F.when(at >= fine, F.lit(bins)).otherwise(F.floor(at * bins / fine)).cast("int")


def _cell(edges: dict[str, list[float]], a: str, b: str, bins: int) -> Column:
    return _coarse(edges, a, bins) * (bins + 1) + _coarse(edges, b, bins)


def quantile_edges(train: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner cut points per feature: at most bins - 1 numbers each reach the driver."""
    points = [i / bins for i in range(1, bins)]
    cast = train.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = cast.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(found[f] or [])) for f in features}


def bin_features(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    """Columns __bin_<feature>: 0 .. number of cuts, and one more for a missing value."""
    cut = [f for f in features if edges[f]]
    flat = [f for f in features if not edges[f]]
    out = df.withColumns({f"__x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in cut})
    if cut:
        out = Bucketizer(
            splitsArray=[[float("-inf"), *edges[f], float("inf")] for f in cut],
            inputCols=[f"__x_{f}" for f in cut],
            outputCols=[f"__bin_{f}" for f in cut],
            handleInvalid="keep",
        ).transform(out)
    out = out.withColumns({f"__bin_{f}": F.when(F.col(f).isNull(), 1.0).otherwise(0.0) for f in flat})
    return out.drop(*[f"__x_{f}" for f in cut])


def _offsets(sizes: Sequence[int]) -> list[int]:
    return [0, *np.cumsum(sizes).tolist()]


def normal_cells(rows: DataFrame, target: str, terms: dict[str, tuple[Column, int]]) -> DataFrame:
    """(i, j, v): rows in which bins i <= j of all terms occur together, and under j = -1 the target summed per bin i.

    These are the normal equations of the one-hot design, as a table. Tasks count blocks of two terms with numpy, at most
    PASS_CELLS cells in a pass (or one block), and the cluster adds up the non-zero cells.
    """
    sizes = [size for _, size in terms.values()]
    at = _offsets(sizes)
    passes, held = [[]], 0
    for i, j in combinations_with_replacement(range(len(sizes)), 2):
        if passes[-1] and held + sizes[i] * sizes[j] > PASS_CELLS:
            passes.append([])
            held = 0
        passes[-1].append((i, j))
        held += sizes[i] * sizes[j]
    names = [f"t{i}" for i in range(len(sizes))]
    coded = rows.select(target, *[index.cast("int").alias(n) for n, (index, _) in zip(names, terms.values())])

    def counted(blocks: list[tuple[int, int]]) -> DataFrame:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = {(i, j): np.zeros(sizes[i] * sizes[j]) for i, j in blocks}
            sums = {i: np.zeros(sizes[i]) for i, j in blocks if i == j}
            for batch in batches:
                y, codes = batch[target].to_numpy(), [batch[n].to_numpy() for n in names]
                for i, held in sums.items():
                    held += np.bincount(codes[i], y, sizes[i])
                for (i, j), held in cells.items():
                    held += np.bincount(codes[i].astype(np.int64) * sizes[j] + codes[j], minlength=len(held))
            for (i, j), held in cells.items():
                used = np.flatnonzero(held)
                yield pd.DataFrame({"i": at[i] + used // sizes[j], "j": at[j] + used % sizes[j], "v": held[used]})
            for i, held in sums.items():
                used = np.flatnonzero(held)
                yield pd.DataFrame({"i": at[i] + used, "j": np.full(len(used), -1), "v": held[used]})

        return coded.mapInPandas(partial, "i bigint, j bigint, v double")

    parts = reduce(DataFrame.unionByName, map(counted, passes))
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _bin_sums(cells: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, summed target) of each bin: two numbers a bin reach the driver."""
    found = cells.filter("j = -1 or i = j").toPandas()
    counts, sums = np.zeros(total), np.zeros(total)
    for held, part in ((sums, found[found["j"] == -1]), (counts, found[found["j"] >= 0])):
        held[part["i"].to_numpy()] = part["v"].to_numpy()
    return counts, sums


def _dense(cells: DataFrame, total: int) -> np.ndarray:
    found = cells.filter("j >= 0").toPandas()
    gram = np.zeros((total, total))
    gram[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return gram + np.triu(gram, 1).T


def normal_sums(rows: DataFrame, target: str, terms: dict[str, tuple[Column, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same as arrays on the driver: (bins x bins counts, target summed per bin)."""
    total = sum(size for _, size in terms.values())
    cells = normal_cells(rows, target, terms).persist()
    try:
        return _dense(cells, total), _bin_sums(cells, total)[1]
    finally:
        cells.unpersist()


def _times(cells: DataFrame, x: np.ndarray) -> np.ndarray:
    """The symmetric matrix of cells times x; tasks add up, and a number for each bin reaches the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = np.zeros(len(x))
        for batch in batches:
            i, j, v = batch["i"].to_numpy(), batch["j"].to_numpy(), batch["v"].to_numpy()
            y += np.bincount(i, v * x[j], len(x))
            off = i != j
            y += np.bincount(j[off], v[off] * x[i[off]], len(x))
        used = np.flatnonzero(y)
        yield pd.DataFrame({"i": used, "y": y[used]})

    out = np.zeros(len(x))
    added = cells.filter("j >= 0").mapInPandas(partial, "i bigint, y double").groupBy("i").agg(F.sum("y").alias("y")).toPandas()
    out[added["i"].to_numpy()] = added["y"].to_numpy()
    return out


def conjugate_gradients(times, b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-9, steps: int = 1000) -> np.ndarray:
    """Solution of a symmetric positive system given by its product with a vector; raises where `steps` don't suffice."""
    x, rest = np.zeros(len(b)), b.copy()
    z = rest / diagonal
    way, size = z, rest @ z
    goal = tolerance * np.sqrt(size)
    for _ in range(steps):
        if np.sqrt(size) <= goal:
            return x
        after = times(way)
        step = size / (way @ after)
        x, rest = x + step * way, rest - step * after
        z = rest / diagonal
        size, before = rest @ z, size
        way = z + size / before * way
    raise RuntimeError(f"the fit did not settle in {steps} steps")


def _fit_terms(rows: DataFrame, target: str, terms: dict[str, tuple[Column, int]], penalty: float):
    """Joint ridge fit of all one-hot terms: (intercept, contributions per term, rows per bin).

    Each term is centred on the training rows; the intercept is not penalised. Any number of bins is fitted: up to
    DENSE_BINS the system is solved on the driver, beyond by conjugate gradients over the stored cells.
    """
    at = _offsets([size for _, size in terms.values()])
    cells = cut_lineage(normal_cells(rows, target, terms))
    counts, sums = _bin_sums(cells, at[-1])
    n, y = counts[: at[1]].sum(), sums[: at[1]].sum()
    b = np.concatenate([[y], sums])
    if at[-1] <= DENSE_BINS:
        gram = _dense(cells, at[-1])
        system = np.block([[np.array([[n]]), counts[None, :]], [counts[:, None], gram + penalty * n * np.eye(len(gram))]])
        solution = np.linalg.solve(system, b)
    else:
        solution = conjugate_gradients(
            lambda x: np.concatenate([[n * x[0] + counts @ x[1:]], counts * x[0] + _times(cells, x[1:]) + penalty * n * x[1:]]),
            b,
            np.concatenate([[n], counts + penalty * n]),
        )
    intercept, shapes, weights = float(solution[0]), {}, {}
    for i, term in enumerate(terms):
        values, held = solution[1 + at[i] : 1 + at[i + 1]], counts[at[i] : at[i + 1]]
        mean = float(values @ held / n)
        shapes[term], weights[term] = (values - mean).tolist(), held.tolist()
        intercept += mean
    return intercept, shapes, weights


def score_pairs(binned: DataFrame, residual: Column, edges: dict[str, list[float]], pairs, bins: int) -> DataFrame:
    """(pair, gain): squared error explained by the cell means of each pair of features."""
    cells = (bins + 1) ** 2
    names = sorted({f for pair in pairs for f in pair})
    coded = binned.select(residual.alias("r"), *[_coarse(edges, f, bins).alias(f"c{i}") for i, f in enumerate(names)])
    places = [(f"c{names.index(a)}", f"c{names.index(b)}") for a, b in pairs]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((len(places), cells)), np.zeros((len(places), cells))
        for batch in batches:
            r = batch["r"].to_numpy()
            for i, (a, b) in enumerate(places):
                cell = batch[a].to_numpy() * (bins + 1) + batch[b].to_numpy()
                sums[i] += np.bincount(cell, r, cells)
                counts[i] += np.bincount(cell, minlength=cells)
        pair, cell = np.nonzero(counts)
        yield pd.DataFrame({"pair": pair, "cell": cell, "s": sums[pair, cell], "n": counts[pair, cell]})

    parts = coded.mapInPandas(partial, "pair bigint, cell bigint, s double, n double")
    added = parts.groupBy("pair", "cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return added.groupBy("pair").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("gain"))


def fit_additive(
    train: DataFrame,
    features: Sequence[str],
    target: str = "meter_reading",
    bins: int = 32,
    interactions: int = 10,
    pair_bins: int = 8,
    penalty: float = 1e-3,
) -> AdditiveModel:
    """Fit on all training rows. Memory on the driver grows with features x bins, not with the rows."""
    features = list(features)
    rows = train.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias(target), *features)
    edges = quantile_edges(rows, features, bins)
    binned = bin_features(rows, features, edges).persist()
    try:
        terms = {f: (F.col(f"__bin_{f}"), len(edges[f]) + 2) for f in features}
        intercept, shapes, weights = _fit_terms(binned, target, terms, penalty)
        chosen: list[tuple[str, str]] = []
        if interactions and len(features) > 1:
            candidates = list(combinations(features, 2))
            fitted = F.lit(intercept)
            for f in features:
                fitted = fitted + _pick(shapes[f], F.col(f"__bin_{f}"))
            gains = score_pairs(binned, F.col(target) - fitted, edges, candidates, pair_bins)
            best = gains.orderBy(F.desc("gain"), "pair").limit(interactions).collect()
            chosen = [candidates[r["pair"]] for r in best]
            for a, b in chosen:
                terms[f"{a} x {b}"] = (_cell(edges, a, b, pair_bins), (pair_bins + 1) ** 2)
            intercept, shapes, weights = _fit_terms(binned, target, terms, penalty)
    finally:
        binned.unpersist()
    pair_names = [f"{a} x {b}" for a, b in chosen]
    return AdditiveModel(
        features,
        edges,
        intercept,
        {f: shapes[f] for f in features},
        chosen,
        pair_bins,
        {p: shapes[p] for p in pair_names},
        weights,
    )


def tune_additive(
    df: DataFrame, features: Sequence[str], folds: DataFrame, grid: Sequence[dict], target: str = "meter_reading"
) -> DataFrame:
    """Metrics of the additive model per fold and parameter set."""

    def scored(train: DataFrame, test: DataFrame, params: dict) -> DataFrame:
        return fit_additive(train, features, target, **params).predict(test)

    return tune_over_folds(df, folds, grid, scored, target)
