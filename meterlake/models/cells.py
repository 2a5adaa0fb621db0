"""Boosted trees grown over cells: the rows of one combination of feature bins are one cell, with its sums in each tree's sample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Most combinations of feature bins, of them in one bucket, rows that are summed at once, and trees whose draws share a long.
MOST_CELLS, BUCKET_CELLS, FLUSH_ROWS, DRAWS = 1 << 22, 1 << 12, 1 << 16, 60


class Node:
    """A node while its tree grows: (count, sum, sum of squares) of its labels, and its split once it has one."""

    def __init__(self, stats: tuple[float, float, float] | None, leaf: bool):
        self.stats, self.leaf, self.impurity = stats, leaf, None if stats is None else impurity(*stats)
        self.gain = self.split = self.left = self.right = None
        self.slot = -1

    @property
    def prediction(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0


def impurity(count, total, squares):
    return (squares - total * total / count) / count if count else 0.0


class Setting:
    """What the library derives from its parameters and the rows: thresholds of each feature, and limits of a split."""

    def __init__(self, spark, trees: GBTRegressor, assembled: DataFrame):
        self.spark, self.trees = spark, trees
        self.gateway = spark.sparkContext._gateway
        self.ml = self.gateway.jvm.org.apache.spark.ml
        trees._transfer_params_to_java()
        self.java = trees._java_obj
        self.categories = self.ml.util.MetadataUtils.getCategoricalFeatures(assembled._jdf.schema().apply(trees.getFeaturesCol()))
        self.fits = self.categories.isEmpty() and not trees.isSet("weightCol") and not trees.isSet("validationIndicatorCol")
        self.fits = self.fits and trees.getLossType() == "squared"
        if not self.fits:
            return
        tools = self.module(self.ml.util, "DatasetUtils")
        rows = tools.extractInstances(self.java, assembled._jdf, getattr(tools, "extractInstances$default$3")())
        algorithm = self.gateway.jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
        strategy = self.java.getOldBoostingStrategy(self.categories, algorithm).treeStrategy()
        meta = self.ml.tree.impl.DecisionTreeMetadata.buildMetadata(rows, strategy, 1, trees.getFeatureSubsetStrategy())
        self.splits = [list(s) for s in self.module(self.ml.tree.impl, "RandomForest").findSplits(rows, meta, trees.getSeed())]
        self.thresholds = [np.array([s.threshold() for s in of]) for of in self.splits]
        self.bins = [len(t) + 1 for t in self.thresholds]
        self.node_features = meta.numFeaturesPerNode()
        self.least_rows, self.least_gain = max(meta.minInstancesPerNode(), meta.minWeightPerNode()), meta.minInfoGain()
        self.depth = trees.getMaxDepth()
        self.fits = float(np.prod(self.bins, dtype=float)) <= MOST_CELLS

    @staticmethod
    def module(package, name: str):
        """A Scala object."""
        return getattr(getattr(package, f"{name}$"), "MODULE$")

    def node_subsets(self, seed: int):
        """For each node that asks, in the library's order, the features it may be split on."""
        count, jvm = len(self.bins), self.gateway.jvm
        draws = jvm.java.util.Random(seed)
        while True:
            chosen = list(range(self.node_features))
            if self.node_features < count:
                place = jvm.org.apache.spark.util.random.XORShiftRandom(draws.nextLong())
                for at in range(self.node_features, count):
                    to = int(place.nextDouble() * (at + 1))
                    if to < self.node_features:
                        chosen[to] = at
            yield chosen


def draws(count: int, rate: float, seed: int) -> list[Column]:
    """Longs that hold a bit for each tree: whether its sample has the row. The library's draws have the same generator and seeds."""
    bits = [F.when(F.rand(seed + m + 1) < rate if rate < 1 else F.lit(True), 1 << (m % DRAWS)).otherwise(0).cast("long") for m in range(count)]
    return [reduce(Column.bitwiseOR, bits[at : at + DRAWS]).alias(f"b{at}") for at in range(0, count, DRAWS)]


def tree_sums(rows: DataFrame, features: Sequence[str], target: str, setting: Setting) -> DataFrame:
    """(bucket, tree, cells, n, s, q), stored: for each tree and cell the number of sampled rows, and the sums of their label's distance
    to the cell's first label and of its square. The row of tree -1 holds the cells' codes, and as s their first labels.

    A row is in a tree's sample by the same draw that the library makes for it. The rows go to the buckets of their cells with a bit for each
    tree; a task holds the sums of one bucket, which has at most BUCKET_CELLS cells.
    """
    trees = setting.trees.getMaxIter()
    thresholds, bins = setting.thresholds, setting.bins
    buckets = -(-int(np.prod(bins)) // BUCKET_CELLS) | 1
    bits = draws(trees, setting.trees.getSubsamplingRate(), setting.trees.getSeed())
    chosen = rows.select(F.col(target).cast("double").alias("y"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(features)], *bits)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            code, y, bits = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(code % buckets, kind="stable")
            code, y, bits = code[order], y[order], bits[order]
            bucket = code % buckets
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(code)]
            parts = list(zip(cuts[:-1], cuts[1:]))
            local = (code // buckets).astype("<u4")
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([local[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([y[a:b].astype("<f8").tobytes() for a, b in parts], pa.binary()), pa.array([bits[a:b].tobytes() for a, b in parts], pa.binary()),
            ], names=["bucket", "cell", "y", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for values, cuts, n in zip(column[1:], thresholds, bins):
                code = code * n + np.searchsorted(cuts, values, side="left")
            held.append((code, column[0], np.stack(column[1 + len(bins) :], axis=1).astype("<i8")))
            size += batch.num_rows
            if size >= 3 * FLUSH_ROWS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, size, sums = None, [], 0, None

        def fold() -> None:
            nonlocal sums, held, size
            cell, y, bits = (b"".join(x) for x in zip(*held))
            cell, y = np.frombuffer(cell, dtype="<u4"), np.frombuffer(y, dtype="<f8")
            taken = np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(len(cell), -1, 8), axis=2, bitorder="little")
            taken = taken[:, :, :DRAWS].reshape(len(cell), -1)[:, :trees]
            order = np.argsort(cell, kind="stable")
            cell, y, taken = cell[order], y[order], taken[order]
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            at = cell[begins]
            if sums is None:
                shape = (-(-int(np.prod(bins)) // buckets) + 1, trees)
                sums = [np.zeros(shape), np.zeros(shape), np.zeros(shape), np.full(shape[0], np.nan)]
            new = np.isnan(sums[3][at])
            sums[3][at[new]] = y[begins[new]]
            off = (y - sums[3][cell])[:, None]
            sums[0][at] += np.add.reduceat(taken, begins, axis=0, dtype=np.float64)
            part = taken * off
            sums[1][at] += np.add.reduceat(part, begins, axis=0)
            part *= off
            sums[2][at] += np.add.reduceat(part, begins, axis=0)
            held, size = [], 0

        def told() -> pd.DataFrame:
            n, s, q, first = sums
            seen = np.flatnonzero(~np.isnan(first))
            codes = (seen * buckets + bucket).astype("<i8").tobytes()
            out = [(bucket, -1, codes, b"", first[seen].tobytes(), b"")]
            out += [(bucket, m, b"", *(np.ascontiguousarray(x[seen, m]).tobytes() for x in (n, s, q))) for m in range(trees)]
            return pd.DataFrame(out, columns=["bucket", "tree", "cells", "n", "s", "q"])

        for frame in frames:
            for key, *row in zip(frame["bucket"].tolist(), frame["cell"], frame["y"], frame["bits"]):
                if key != bucket:
                    if held:
                        fold()
                    if sums is not None:
                        yield told()
                    bucket, sums = key, None
                held.append(row)
                size += len(row[1]) // 8
                if size >= FLUSH_ROWS // 2:
                    fold()
        if held:
            fold()
        if sums is not None:
            yield told()

    sent = chosen.mapInArrow(placed, "bucket int, cell binary, y binary, bits binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket")
    path = scratch_path(setting.spark, "tree-sums")
    key = "spark.sql.codegen.wholeStage"
    before = setting.spark.conf.get(key)
    setting.spark.conf.set(key, "false")  # a hundred draws in one method are more than the JVM compiles
    try:
        found.mapInPandas(summed, "bucket int, tree int, cells binary, n binary, s binary, q binary").write.parquet(path)
    finally:
        setting.spark.conf.set(key, before)
    return setting.spark.read.parquet(path)


def collected(sums: DataFrame, first: int, last: int) -> dict[int, pa.Table]:
    """Rows of the trees from first to last, in order of bucket."""
    table = sums.filter(F.col("tree").between(first, last)).toArrow()
    table = table.sort_by([("tree", "ascending"), ("bucket", "ascending")])
    tree = table.column("tree").to_numpy()
    return {m: table.slice(int(np.searchsorted(tree, m)), int((tree == m).sum())) for m in range(first, last + 1)}


def values(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=dtype)


def best_split(histogram: dict[int, np.ndarray], node: Node, setting: Setting) -> tuple[float, tuple | None]:
    """(gain, (feature, position, left sums, right sums)) of the node's best split, as the library chooses it; None for no valid one."""
    best = (-np.inf, None)
    for feature, binned in histogram.items():
        if setting.bins[feature] < 2:
            continue
        sums = np.cumsum(binned, axis=1)
        left = sums[:, :-1]
        right = sums[:, -1:] - left
        if node.stats is None:
            node.stats = tuple((left[:, 0] + right[:, 0]).tolist())
            node.impurity = impurity(*node.stats)
        with np.errstate(divide="ignore", invalid="ignore"):
            below, above = (np.where(c > 0, (q - s * s / c) / c, 0.0) for c, s, q in (left, right))
            gain = node.impurity - left[0] / (left[0] + right[0]) * below - right[0] / (left[0] + right[0]) * above
        gain = np.where((left[0] >= setting.least_rows) & (right[0] >= setting.least_rows) & (gain >= setting.least_gain), gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), (feature, at, tuple(left[:, at].tolist()), tuple(right[:, at].tolist())))
    if node.stats is None:
        node.stats = tuple(next(iter(histogram.values())).sum(axis=1).tolist())
        node.impurity = impurity(*node.stats)
    return best


def grow(binned: list[np.ndarray], sums: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int, setting: Setting) -> tuple[Node, np.ndarray]:
    """A tree over cells, and its prediction for each. Nodes are split level by level, in the order of the library's stack."""
    root, subsets = Node(None, False), setting.node_subsets(seed)
    predicted, slot = np.zeros(len(sums[0])), np.zeros(len(sums[0]), dtype=np.int64)
    level, active, depth = [root], np.arange(len(sums[0])), 0
    while level:
        asked = [next(subsets) for _ in level]
        place = slot[active]
        weights = [x[active] for x in sums]
        found = {}
        for f in sorted({f for chosen in asked for f in chosen}):
            at = place * setting.bins[f] + binned[f][active]
            found[f] = np.stack([np.bincount(at, w, len(level) * setting.bins[f]).reshape(len(level), -1) for w in weights])
        below, turns, ahead = [], {}, depth + 1 == setting.depth
        for i, node in enumerate(level):
            gain, how = best_split({f: found[f][:, i] for f in asked[i]}, node, setting)
            if how is None or gain <= 0 or depth == setting.depth:
                node.leaf, node.impurity = True, -1.0 if how is None else node.impurity
                continue
            feature, at, left, right = how
            node.gain, node.split = gain, (feature, at)
            for side, stats in (("left", left), ("right", right)):
                child = Node(stats, False)
                child.leaf = ahead or abs(child.impurity) < 2.0**-52
                setattr(node, side, child)
                if not child.leaf:
                    below.insert(0, child)
            turns[i] = node
        for i, node in enumerate(below):
            node.slot = i
        goes, worth = np.full((len(level), 2), -1, dtype=np.int64), np.zeros((len(level), 2))
        right = np.zeros(len(active), dtype=np.int64)
        for i, node in enumerate(level):
            worth[i] = node.prediction
            if i in turns:
                goes[i] = node.left.slot, node.right.slot
                worth[i] = node.left.prediction, node.right.prediction
        for f in {node.split[0] for node in turns.values()}:
            cut = np.full(len(level), np.iinfo(np.int64).max)
            for i, node in turns.items():
                if node.split[0] == f:
                    cut[i] = node.split[1]
            right |= binned[f][active] > cut[place]
        predicted[active] = worth[place, right]
        slot[active] = goes[place, right]
        active = active[slot[active] >= 0]
        level, depth = below, depth + 1
    return root, predicted


def java_node(node: Node, setting: Setting, stats):
    """(the library's node, its prediction if it is a leaf); two leaves of one prediction become one."""
    tree = setting.ml.tree
    held = setting.gateway.new_array(setting.gateway.jvm.double, 3)
    held[0], held[1], held[2] = node.stats
    known = stats(held, int(node.stats[0]))
    if node.left is not None:
        (left, one), (right, other) = java_node(node.left, setting, stats), java_node(node.right, setting, stats)
        if one is None or one != other:
            feature, at = node.split
            return tree.InternalNode(node.prediction, node.impurity, node.gain, left, right, setting.splits[feature][at], known), None
        return tree.LeafNode(one, node.impurity, known), one
    return tree.LeafNode(node.prediction, float(node.impurity), known), node.prediction


def fit_over_cells(assembler: VectorAssembler, trees: GBTRegressor, rows: DataFrame) -> PipelineModel | None:
    """The library's boosted trees from one pass over the rows, whatever the number of trees; None where its cells would be too many.

    A tree's sample doesn't depend on the trees before it, and all rows of a cell have one prediction. So the sums of each tree's sample in
    each cell, taken once, hold all that its splits need. Other losses, weights and categories are left to the library.
    """
    spark, features, target = rows.sparkSession, assembler.getInputCols(), trees.getLabelCol()
    setting = Setting(spark, trees, assembler.transform(rows))
    if not setting.fits:
        return None
    sums, count, step = tree_sums(rows, features, target, setting), trees.getMaxIter(), trees.getStepSize()
    known = collected(sums, -1, -1)[-1]
    code, first = values(known, "cells", "<i8"), values(known, "s", "<f8")
    binned = []
    for n in reversed(setting.bins):
        binned.insert(0, (code % n).astype(np.int32))
        code = code // n
    gateway, at_once = setting.gateway, max(1, (64 << 20) // (24 * max(1, len(first))))
    kinds = setting.ml.regression
    grown, weights = gateway.new_array(kinds.DecisionTreeRegressionModel, count), gateway.new_array(gateway.jvm.double, count)
    stats, nothing = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, setting.ml.param.ParamMap.empty()
    so_far, taken = np.zeros(len(first)), {}
    for m in range(count):
        if m not in taken:
            taken = collected(sums, m, min(count, m + at_once) - 1)
        n, s, q = (values(taken[m], c, "<f8") for c in ("n", "s", "q"))
        # The first tree has the label; later ones twice the distance to the prediction.
        times, off = (1.0, first) if m == 0 else (2.0, first - so_far)
        squares = times * times * (q + 2.0 * off * s + n * off * off)
        root, predicted = grow(binned, (n, times * (s + n * off), squares), trees.getSeed() + m, setting)
        weights[m] = 1.0 if m == 0 else step
        so_far = so_far + predicted * weights[m]
        grown[m] = setting.java.copyValues(kinds.DecisionTreeRegressionModel(java_node(root, setting, stats)[0], len(features)), nothing)
    made = setting.java.copyValues(kinds.GBTRegressionModel(setting.java.uid(), grown, weights, len(features)), nothing)
    return PipelineModel([assembler, trees._copyValues(trees._create_model(made))])
