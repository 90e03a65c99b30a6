"""Extremely randomised trees: all trees grow together, level by level, from all rows.

Each level takes two passes over the rows. The first gives the sums and the range of every feature of each open node; a cut is
drawn for each feature that varies, uniformly between the least and the greatest value. The second sums what lies at or
below each cut, and the best cut splits the node (ties: the feature first drawn). Draws depend on seed, tree and the
node's place in its level alone, so the trees are the same for any partitioning, up to rounding of sums.

A node stays a leaf with fewer than two rows, one target, no varying feature, or at `max_depth`."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree_sums import Summing, Trees, by_slot, matrix, summed, training_rows

#: A node whose targets vary by less than this share of their square counts as having one target.
FLAT = 1e-12


def _weights(y: np.ndarray, n_classes: int) -> np.ndarray:
    """What is summed of each row: ones per class, or 1, y and its square."""
    return np.eye(n_classes)[y.astype(int)] if n_classes else np.stack([np.ones(len(y)), y, y * y], axis=1)


def draws(seed: int, tree: int, level: int, n_nodes: int, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each open node of a tree and each feature: the place in the order of trying, and the place of the cut in its range."""
    rng = np.random.default_rng([seed, tree, level])
    return rng.random((n_nodes, n_features)), rng.random((n_nodes, n_features))


def chosen_cuts(low: np.ndarray, high: np.ndarray, order: np.ndarray, place: np.ndarray, n_tried: int) -> np.ndarray:
    """The cut of each feature that is tried: of those that vary, the `n_tried` first in order; NaN of all others."""
    key = np.where(high > low, order, np.inf)
    last = np.sort(key, axis=1)[:, min(n_tried, key.shape[1]) - 1:][:, :1]
    with np.errstate(invalid="ignore"):
        cut = low + place * (high - low)
        cut = np.where(cut < high, cut, low)
    return np.where((key <= last) & np.isfinite(key), cut, np.nan)


def gains(left: np.ndarray, whole: np.ndarray, n_classes: int) -> np.ndarray:
    """How much the squared error, or the Gini impurity, of the rows falls: (nodes, features) of the sums (nodes, features,
    numbers) left of the cuts and the sums (nodes, numbers) of the nodes. NaN where a side is empty."""
    right = whole[:, None, :] - left

    def score(sums: np.ndarray) -> np.ndarray:
        n, square = (sums.sum(-1), (sums * sums).sum(-1)) if n_classes else (sums[..., 0], sums[..., 1] ** 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, square / n, np.nan)
    return score(left) + score(right) - score(whole)[:, None]


def best_cuts(cuts: np.ndarray, left: np.ndarray, whole: np.ndarray, order: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, gain) of the best cut of each node, minus infinity if it has none. Sums differ in their last digits with the
    partitions, so gains that are as good as equal count as ties."""
    gained = gains(left, whole, n_classes)
    gained = np.where(np.isnan(cuts) | np.isnan(gained), -np.inf, gained)
    top = gained.max(axis=1)
    size = whole.sum(axis=1) if n_classes else whole[:, 2]
    near = gained >= np.where(np.isfinite(top), top - 1e-9 * np.abs(top) - 1e-12 * size, np.inf)[:, None]
    return np.where(near, order, np.inf).argmin(axis=1), top


def is_pure(whole: np.ndarray, n_classes: int) -> np.ndarray:
    if n_classes:
        return whole.max(axis=1) == whole.sum(axis=1)
    n, s, ss = whole.T
    return ss - s * s / np.maximum(n, 1) <= FLAT * np.maximum(ss, 1e-300)


def _ranges(n_slots: int, n_features: int) -> Summing:
    def sums(x: np.ndarray, part: pa.RecordBatch, slots: np.ndarray) -> np.ndarray:
        out = np.full((n_slots, 2 * n_features), np.inf)  # the least value, and minus the greatest
        rows, starts, present = by_slot(slots)
        if len(rows):
            out[present, :n_features] = np.minimum.reduceat(x[rows], starts, axis=0)
            out[present, n_features:] = -np.maximum.reduceat(x[rows], starts, axis=0)
        return out
    return sums


def _whole(n_slots: int, n_classes: int, width: int) -> Summing:
    def sums(x: np.ndarray, part: pa.RecordBatch, slots: np.ndarray) -> np.ndarray:
        total = _weights(part.column(0).to_numpy(zero_copy_only=False), n_classes).sum(axis=0)
        return np.tile(total, (n_slots, 1))
    return sums


def _lefts(cuts: np.ndarray, n_classes: int, width: int) -> Summing:
    def sums(x: np.ndarray, part: pa.RecordBatch, slots: np.ndarray) -> np.ndarray:
        n_features = x.shape[1]
        out = np.zeros((len(cuts), n_features, width))
        rows, starts, present = by_slot(slots)
        if len(rows):
            weights = _weights(part.column(0).to_numpy(zero_copy_only=False), n_classes)[rows]
            below = x[rows] <= np.repeat(cuts[present], np.diff([*starts, len(rows)]), axis=0)
            for k in range(width):
                out[present, :, k] = np.add.reduceat(below * weights[:, k:k + 1], starts, axis=0)
        return out.reshape(len(cuts), -1)
    return sums


@dataclass
class ExtraTrees:
    trees: Trees
    n_classes: int
    gain: np.ndarray  # of each feature, over all splits

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the mean of the trees' leaves: `prediction`, and for classes the shares as `probability`."""
        trees, n_classes = df.sparkSession.sparkContext.broadcast(self.trees), self.n_classes  # at most 2 ** depth leaves a tree

        def leaves(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                out = []
                for i in range(0, len(x), 1024):
                    part = matrix(x.slice(i, 1024))
                    out.append(trees.value.value[trees.value.leaves(part)].mean(axis=1))
                values = np.concatenate(out) if out else np.zeros((0, max(1, n_classes)))
                yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * max(1, n_classes), values.ravel())

        mean = F.arrow_udf(leaves, "array<double>", F.ArrowUDFType.SCALAR_ITER)(vector_to_array("features"))
        out = df.withColumn("probability", mean)
        if not n_classes:
            return out.select(*df.columns, F.col("probability")[0].alias("prediction"))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.select(*df.columns, best.cast("double").alias("prediction"), "probability")

    def importances(self) -> list[float]:
        return (self.gain / (self.gain.sum() or 1.0)).tolist()


def fit(train: DataFrame, *, n_trees: int, max_depth: int, n_tried: int | None, n_classes: int = 0, seed: int = 0) -> ExtraTrees:
    """Grow `n_trees` on (y, features); `n_tried` features per node, all if None. `n_classes` 0 is a regression."""
    rows = training_rows(train)
    n_features = rows.agg(F.max(F.size("x"))).first()[0]
    if n_features is None or n_features <= 0:
        raise ValueError("there are no rows or no features to grow trees from")
    n_tried, width = min(n_tried or n_features, n_features), n_classes or 3
    centre = 0.0 if n_classes else rows.agg(F.avg("y")).first()[0]
    rows = rows.withColumn("y", F.col("y") - F.lit(centre))
    trees, gain, n_tasks = Trees.stumps(n_trees, max(1, n_classes)), np.zeros(n_features), rows.rdd.getNumPartitions()
    nodes, tree_of = np.arange(n_trees), np.arange(n_trees)  # in the order of trees
    whole = summed(rows, trees, nodes, width, lambda s: _whole(s.stop - s.start, n_classes, width), n_tasks=n_tasks)
    for level in range(max_depth + 1):
        n = whole.sum(axis=1) if n_classes else whole[:, 0]
        trees.value[nodes] = whole / n[:, None] if n_classes else whole[:, 1:2] / n[:, None] + centre
        grows = (n >= 2) & ~is_pure(whole, n_classes) & (level < max_depth)
        nodes, tree_of, whole = nodes[grows], tree_of[grows], whole[grows]
        if not len(nodes):
            break
        ends = summed(rows, trees, nodes, 2 * n_features, lambda s: _ranges(s.stop - s.start, n_features), np.minimum, np.inf, n_tasks=n_tasks)
        order, place = (np.concatenate(d) for d in zip(*[draws(seed, t, level, n, n_features) for t, n in enumerate(np.bincount(tree_of)) if n]))
        cuts = chosen_cuts(ends[:, :n_features], -ends[:, n_features:], order, place, n_tried)
        left = summed(rows, trees, nodes, n_features * width, lambda s: _lefts(cuts[s], n_classes, width), n_tasks=n_tasks)
        left = left.reshape(len(nodes), n_features, width)
        best, top = best_cuts(cuts, left, whole, order, n_classes)
        split = np.isfinite(top)
        nodes, tree_of, best, cuts, left, whole, top = (v[split] for v in (nodes, tree_of, best, cuts, left, whole, top))
        here = np.arange(len(nodes))
        np.add.at(gain, best, top)
        children = trees.split(nodes, best, cuts[here, best])
        lefts = left[here, best]
        nodes, tree_of = np.stack([children, children + 1], axis=1).ravel(), np.repeat(tree_of, 2)
        whole = np.stack([lefts, whole - lefts], axis=1).reshape(-1, width)
    return ExtraTrees(trees, n_classes, gain)
