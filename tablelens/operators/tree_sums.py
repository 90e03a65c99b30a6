"""What growing trees level by level needs from the rows: per-node sums made in every task and merged by blocks of nodes.

Trees are arrays of nodes (`Trees`), small enough for the driver: their depth is bounded. A task sends its rows down all
trees at once, sums what a level asks for over the open nodes, and sends one row per block of them; Spark adds the blocks
up. So what is shuffled grows with tasks and open nodes, never with rows, and no task holds more than a batch of rows and
the open nodes of one pass (`LIMIT` numbers; more of them take more passes)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a pass sums in a task, numbers that travel in one row, and rows that are sent down the trees at once.
LIMIT, BLOCK, SLICE = 4_000_000, 16_384, 4096

#: Sums over the rows of a slice: (inputs, target, slot of each row and tree or -1) to an array (slots, numbers).
Summing = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Trees:
    """Nodes of many trees. An inner node sends a row to `left` where its `feature` is at most `cut`, or is NaN and
    `nan_left` holds, else to the node after it; a leaf's feature is -1."""
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    nan_left: np.ndarray
    value: np.ndarray  # a row per node

    @staticmethod
    def stumps(n_trees: int, n_values: int) -> "Trees":
        return Trees(np.arange(n_trees), np.full(n_trees, -1), np.zeros(n_trees), np.zeros(n_trees, int), np.zeros(n_trees, bool),
                     np.zeros((n_trees, n_values)))

    def split(self, nodes: np.ndarray, features: np.ndarray, cuts: np.ndarray, nan_left: np.ndarray | bool = False) -> np.ndarray:
        """Give the nodes two children each; returns the left ones."""
        left = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes], self.nan_left[nodes] = features, cuts, left, nan_left
        n = 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.full(n, -1)])
        self.cut, self.left, self.nan_left = (np.concatenate([a, np.zeros(n, a.dtype)]) for a in (self.cut, self.left, self.nan_left))
        self.value = np.concatenate([self.value, np.zeros((n, self.value.shape[1]))])
        return left

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at, rows = np.broadcast_to(self.root, (len(x), len(self.root))).copy(), np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            value = x[rows, np.maximum(feature, 0)]
            at = np.where(inner, self.left[at] + np.where(np.isnan(value), ~self.nan_left[at], value > self.cut[at]), at)


def training_rows(train: DataFrame, *columns: str) -> DataFrame:
    """(y, x, ...): the target, the features as an array, and other numbers."""
    return train.select(F.col("y").cast("double").alias("y"), vector_to_array("features").alias("x"), *columns)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_slot(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in the order of their slots, where each slot present begins, those slots) of the rows and trees with a slot."""
    flat = slots.ravel()
    order = np.argsort(flat, kind="stable")[np.count_nonzero(flat < 0):]
    present, starts = np.unique(flat[order], return_index=True)
    return order // slots.shape[1], starts, present


def split_inputs(part: pa.RecordBatch) -> np.ndarray:
    return matrix(part.column(1))


def summed(
    rows: DataFrame, trees: Trees, open_nodes: np.ndarray, width: int, make: Callable[[slice], Summing], merge: np.ufunc = np.add, empty: float = 0.0,
    inputs: Callable[[pa.RecordBatch], np.ndarray] = split_inputs, n_tasks: int | None = None,
) -> np.ndarray:
    """(open nodes, width): the sums over the rows of each open node, merged over all tasks. `make` gives what is summed for a
    range of the open nodes; `empty` is what no row gives; `inputs` makes the inputs of a slice of rows. Where the
    sums of all tasks (`n_tasks`) are no more than LIMIT numbers they are merged here, else by a shuffle."""
    per_pass, per_block = max(1, LIMIT // width), max(1, BLOCK // width)
    out = np.full((len(open_nodes), width), empty)
    for at in range(0, len(open_nodes), per_pass):
        some = open_nodes[at:at + per_pass]
        sums = make(slice(at, at + len(some)))
        slot_of = np.full(len(trees.feature), -1)
        slot_of[some] = np.arange(len(some))

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.full((len(some), width), empty)
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    x = inputs(part)
                    merge(total, sums(x, part, slot_of[trees.leaves(x)]), out=total)
            blocks = range(0, len(some), per_block)
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(blocks), pa.int64()),
                                              "sums": pa.array([total[b:b + per_block].tobytes() for b in blocks], pa.binary())})

        def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, None
            done: list[tuple[int, bytes]] = []
            for batch in batches:
                for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if block != key:
                        if key is not None:
                            done.append((key, total.tobytes()))
                        key, total = block, np.full(len(raw) // 8, empty)
                    merge(total, np.frombuffer(raw), out=total)
            if key is not None:
                done.append((key, total.tobytes()))
            yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in done], pa.int64()), "sums": pa.array([r for _, r in done], pa.binary())})

        parts = rows.mapInArrow(partial, "block long, sums binary")
        if n_tasks is None or n_tasks * len(some) * width > LIMIT:
            parts = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block long, sums binary")
        for r in parts.collect():  # the open nodes of a pass, or those of all tasks: at most LIMIT numbers
            found = np.frombuffer(r["sums"]).reshape(-1, width)
            here = out[at + r["block"]:at + r["block"] + len(found)]
            merge(here, found, out=here)
    return out
