"""Gradient boosting on histograms: every round grows one tree per class (one for a regression or two classes) together.

Features are cut into at most 255 bins once, at values of an approximate ranking; a bin of its own holds missing values. A level
takes one pass: the sums of gradient, Hessian and rows per (open node, feature, bin). Of two siblings only the smaller one
is summed, the other is the parent minus it. Each cut is tried with missing values on either side. Trees grow by levels to
`max_depth`; then the best gain first is kept up to `max_leaves`, which is the tree that leaf-wise growth gives.

Losses: squared error; the logistic loss; for more classes the softmax with a tree per class in every round. What the rounds
have added so far is written with the rows every `STAGED` rounds, so that a pass never walks more trees than those."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .tree_sums import Summing, Trees, matrix, summed, training_rows

#: The bin of missing values, rounds between staged copies, least Hessian of a child.
MISSING, STAGED, LEAST_HESSIAN = 255, 20, 1e-3


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    step: float = 0.1
    max_depth: int = 5
    max_leaves: int = 31
    bins: int = 255
    least_rows: int = 20
    l2: float = 0.0


def bin_edges(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """The upper ends of all bins but the last, of each feature."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    value = F.when(~F.isnan("col"), F.col("col"))
    found = rows.select(F.posexplode("x").alias("pos", "col")).groupBy("pos").agg(
        F.percentile_approx(value, shares, 20 * bins).alias("edges"), F.max(value).alias("top"), F.min(value).alias("low"))
    edges = [np.zeros(0)] * n_features
    for r in found.collect():  # a row per feature
        if r["top"] is not None:
            # with few values each is an edge, as the ranking gives all of them
            edges[r["pos"]] = np.array(sorted({e for e in [r["low"], *r["edges"]] if e < r["top"]})[:bins - 1])
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(e, x[:, f], "left"))
    return out


def gradients(y: np.ndarray, margin: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, a column per tree of a round."""
    if not n_classes:
        return margin - y[:, None], np.ones_like(margin)
    p = chances(margin)[:, 1:] if n_classes == 2 else chances(margin)
    own = y[:, None] == (np.array([1]) if n_classes == 2 else np.arange(n_classes))
    return p - own, p * (1 - p)


def chances(margin: np.ndarray) -> np.ndarray:
    """Probabilities of all classes."""
    if margin.shape[1] == 1:
        margin = np.concatenate([np.zeros_like(margin), margin], axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Layout:
    """Where the bins of each feature stand in a histogram; the last of each is for missing values."""
    start: np.ndarray
    n_cuts: np.ndarray

    @staticmethod
    def of(edges: list[np.ndarray]) -> "Layout":
        n = np.array([len(e) for e in edges])
        return Layout(np.concatenate([[0], np.cumsum(n + 2)])[:-1], n)

    @property
    def width(self) -> int:
        return int((self.n_cuts + 2).sum())


def best_splits(hist: np.ndarray, layout: Layout, s: Settings) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, missing left, rows left) of the best cut of each histogram (nodes, 3, bins)."""
    feature = np.repeat(np.arange(len(layout.start)), layout.n_cuts + 2)
    place = np.arange(layout.width) - layout.start[feature]
    gone = layout.start + layout.n_cuts + 1
    upto = np.cumsum(hist, axis=2)
    before = np.concatenate([np.zeros((*hist.shape[:2], 1)), upto], axis=2)[:, :, layout.start]
    left = upto - before[:, :, feature]
    whole = left[:, :, gone]  # of all bins of each feature
    missing = hist[:, :, gone]
    right_ways = []
    for low in (left, left + missing[:, :, feature]):
        high = whole[:, :, feature] - low
        fits = (place < layout.n_cuts[feature]) & (low[:, 2] >= s.least_rows) & (high[:, 2] >= s.least_rows) & (
            low[:, 1] >= LEAST_HESSIAN) & (high[:, 1] >= LEAST_HESSIAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low[:, 0] ** 2 / (low[:, 1] + s.l2) + high[:, 0] ** 2 / (high[:, 1] + s.l2) - (
                whole[:, 0] ** 2 / (whole[:, 1] + s.l2))[:, feature]
        right_ways.append(np.where(fits, gain, -np.inf))
    # the way without missing values on the left comes first where both are as good
    gain = np.concatenate(right_ways, axis=1)
    top = gain.max(axis=1)
    scale = np.abs(top) + 1e-3 * np.abs(hist[:, 0]).sum(axis=1)
    at = (gain >= np.where(np.isfinite(top), top - 1e-9 * scale, np.inf)[:, None]).argmax(axis=1)
    cut, nan_left = at % layout.width, at >= layout.width
    node = np.arange(len(hist))
    n_left = np.where(nan_left, left[node, 2, cut] + missing[node, 2, feature[cut]], left[node, 2, cut])
    return np.where(top > 1e-12 * scale, top, -np.inf), feature[cut], place[cut], nan_left, n_left


def _unpacked(part: pa.RecordBatch) -> np.ndarray:
    bins = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
    return np.where(bins == MISSING, np.nan, bins)


def _margins(part: pa.RecordBatch, x: np.ndarray, since: Trees | None, n_trees: int, step: float) -> np.ndarray:
    margin = matrix(part.column(2))
    if since is not None:
        added = since.value[since.leaves(x)][:, :, 0]
        margin = margin + step * added.reshape(len(x), -1, n_trees).sum(axis=1)
    return margin


def _histograms(layout: Layout, since: Trees | None, n_trees: int, n_classes: int, step: float):
    def make(some: slice) -> Summing:
        n_slots = some.stop - some.start

        def sums(x: np.ndarray, part: pa.RecordBatch, slots: np.ndarray) -> np.ndarray:
            out = np.zeros((n_slots, 3, layout.width))
            flat = slots.ravel()
            kept = np.flatnonzero(flat >= 0)
            if len(kept):
                row, slot = kept // n_trees, flat[kept]
                g, h = gradients(part.column(0).to_numpy(zero_copy_only=False), _margins(part, x, since, n_trees, step), n_classes)
                g, h = g.ravel()[kept], h.ravel()[kept]
                for f, (start, n_cuts) in enumerate(zip(layout.start, layout.n_cuts)):
                    size = n_cuts + 2
                    own = np.where(np.isnan(x[row, f]), n_cuts + 1, x[row, f]).astype(np.int64)
                    for k, w in enumerate((g, h, None)):
                        out[:, k, start:start + size] = np.bincount(slot * size + own, w, n_slots * size).reshape(n_slots, size)
            return out.reshape(n_slots, -1)
        return sums
    return make


def grow_round(
    rows: DataFrame, layout: Layout, since: Trees | None, n_trees: int, n_classes: int, s: Settings, n_tasks: int | None = None,
) -> tuple[Trees, np.ndarray]:
    """The trees of a round over bins, and the gain of each feature."""
    trees, width = Trees.stumps(n_trees, 1), 3 * layout.width
    make = _histograms(layout, since, n_trees, n_classes, s.step)

    def of(nodes: np.ndarray) -> np.ndarray:
        return summed(rows, trees, nodes, width, make, inputs=_unpacked, n_tasks=n_tasks).reshape(len(nodes), 3, -1)

    nodes, tree_of = np.arange(n_trees), np.arange(n_trees)
    hist, gain_of = of(nodes), {}
    first = slice(layout.start[0], layout.start[0] + layout.n_cuts[0] + 2)  # all rows stand in the bins of any feature
    for level in range(s.max_depth + 1):
        g, h = hist[:, 0, first].sum(axis=1), hist[:, 1, first].sum(axis=1)
        trees.value[nodes, 0] = np.where(h + s.l2 > 0, -g / np.maximum(h + s.l2, 1e-300), 0.0)
        if level == s.max_depth:
            break
        gain, feature, cut, nan_left, n_left = best_splits(hist, layout, s)
        split = np.isfinite(gain)
        if not split.any():
            break
        nodes, hist, gain, feature, cut, nan_left, n_left = (v[split] for v in (nodes, hist, gain, feature, cut, nan_left, n_left))
        gain_of |= dict(zip(nodes.tolist(), gain.tolist()))
        left = trees.split(nodes, feature, cut.astype(float), nan_left)
        small_left = 2 * n_left <= hist[:, 2, first].sum(axis=1)
        small = of(np.where(small_left, left, left + 1))
        other = hist - small
        pair = np.where(small_left[:, None, None, None], np.stack([small, other], axis=1), np.stack([other, small], axis=1))
        nodes, hist = np.stack([left, left + 1], axis=1).ravel(), pair.reshape(-1, *pair.shape[2:])
    return trees, _best_first(trees, gain_of, s.max_leaves, len(layout.start))


def _best_first(trees: Trees, gain_of: dict[int, float], max_leaves: int, n_features: int) -> np.ndarray:
    """Make leaves of the inner nodes that best-first growth would not have reached; returns the gain of each feature."""
    total, reached = np.zeros(n_features), set()
    for root in trees.root.tolist():
        heap, leaves = [(-gain_of[root], root)] if root in gain_of else [], 1
        while heap and leaves < max_leaves:
            gain, node = heapq.heappop(heap)
            reached.add(node)
            total[trees.feature[node]] -= gain
            leaves += 1
            for child in (int(trees.left[node]), int(trees.left[node]) + 1):
                if child in gain_of:
                    heapq.heappush(heap, (-gain_of[child], child))
    cut_off = [n for n in gain_of if n not in reached]
    trees.feature[cut_off] = -1
    return total


def joined(rounds: list[Trees]) -> Trees:
    offsets = np.cumsum([0, *[len(t.feature) for t in rounds[:-1]]])
    return Trees(np.concatenate([t.root + o for t, o in zip(rounds, offsets)]), *(np.concatenate([getattr(t, c) for t in rounds]) for c in ("feature", "cut")),
                 np.concatenate([t.left + o for t, o in zip(rounds, offsets)]), *(np.concatenate([getattr(t, c) for t in rounds]) for c in ("nan_left", "value")))


@dataclass
class Boosted:
    trees: Trees
    base: np.ndarray  # the margins before the first round
    step: float
    n_classes: int
    gain: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.step * self.trees.value[self.trees.leaves(x)][:, :, 0].reshape(len(x), -1, len(self.base)).sum(axis=1)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `prediction`, and for classes `probability`."""
        model = df.sparkSession.sparkContext.broadcast(self)  # rounds x classes x at most max_leaves leaves
        width = max(1, self.n_classes)

        def values(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                out = [model.value.margins(matrix(x.slice(i, 1024))) for i in range(0, len(x), 1024)]
                found = np.concatenate(out) if out else np.zeros((0, width))
                found = chances(found) if model.value.n_classes and len(found) else found
                yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, found.ravel())

        out = df.withColumn("probability", F.arrow_udf(values, "array<double>", F.ArrowUDFType.SCALAR_ITER)(vector_to_array("features")))
        if not self.n_classes:
            return out.select(*df.columns, F.col("probability")[0].alias("prediction"))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.select(*df.columns, best.cast("double").alias("prediction"), "probability")

    def importances(self) -> list[float]:
        return (self.gain / (self.gain.sum() or 1.0)).tolist()


def _base(rows: DataFrame, n_classes: int) -> np.ndarray:
    if not n_classes:
        return np.array([rows.agg(F.avg("y")).first()[0]])
    counts = np.zeros(n_classes)
    for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect():  # a row per class
        counts[int(r["y"])] = r["n"]
    share = np.log(np.maximum(counts, 1e-9) / counts.sum())
    return share[1:] - share[:1] if n_classes == 2 else share


def fit(train: DataFrame, settings: Settings = Settings(), *, n_classes: int = 0) -> Boosted:
    """Boost on (y, features); `n_classes` 0 is a regression."""
    rows = training_rows(train)
    n_features = rows.agg(F.max(F.size("x"))).first()[0]
    if n_features is None or n_features <= 0:
        raise ValueError("there are no rows or no features to grow trees from")
    base, edges = _base(rows, n_classes), bin_edges(rows, n_features, min(settings.bins, MISSING))
    layout, n_trees = Layout.of(edges), len(base)

    def to_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(matrix(batch.column(1)), edges) if batch.num_rows else np.zeros((0, n_features), np.uint8)
            start = pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * n_trees, np.tile(base, len(bins)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), start], names=["y", "bins", "margin"])

    schema = "y double, bins binary, margin array<double>"
    rows = stage(rows.mapInArrow(to_bins, schema))
    done, fresh, gain, n_tasks = [], [], np.zeros(n_features), rows.rdd.getNumPartitions()
    for number in range(settings.rounds):
        trees, gained = grow_round(rows, layout, joined(fresh) if fresh else None, n_trees, n_classes, settings, n_tasks)
        if not (trees.feature >= 0).any() and not np.any(trees.value):
            break
        fresh.append(trees)
        done.append(trees)
        gain += gained
        if len(fresh) == STAGED and number + 1 < settings.rounds:
            since = joined(fresh)

            def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margin = _margins(batch, _unpacked(batch), since, n_trees, settings.step) if batch.num_rows else np.zeros((0, n_trees))
                    held = pa.ListArray.from_arrays(np.arange(len(margin) + 1, dtype=np.int32) * n_trees, margin.ravel())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["y", "bins", "margin"])
            rows, fresh = stage(rows.mapInArrow(added, schema)), []
    trees = joined(done) if done else Trees.stumps(n_trees, 1)
    inner = trees.feature >= 0  # cuts are bins so far
    trees.cut[inner] = [edges[f][int(b)] for f, b in zip(trees.feature[inner], trees.cut[inner])]
    return Boosted(trees, base, settings.step, n_classes, gain)
