"""Exact k nearest neighbours as a partitioned join.

Training points go to the cell of their nearest pivot, big cells are cut into blocks. A query is first asked of one block of
its own cell: its k-th distance there is as far as it ever has to look. It then visits only the blocks of cells that can
hold a point as near, by the radius of the cell and by the plane half way between both pivots. Visitors of busy blocks
are cut into groups, so that a task holds a bounded block of each side; the candidates of a query are merged at the end.

Inside a block both sides are cut into boxes of a few points each, by medians of the widest side. Queries of one box are
compared only with boxes that can hold a point as near as the k-th of the nearest boxes. All bounds keep equal distances."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage, together
from .split import row_hash

#: Rows of either side a task may hold at once.
BLOCK_ROWS = 20_000
MAX_PIVOTS = 2_048
#: Cells of the distance matrix computed at a time.
MATRIX_CELLS = 2_000_000
#: Points of a box, and partitions that blocks are dealt to at most.
BOX_ROWS, MAX_PARTS = 64, 4_096
#: Relative slack of the pruning bounds, against rounding.
SLACK = 1e-9


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`, dimension by dimension."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        total += diff * diff
    return total


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long arrays as rows; a missing number is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _strips(n: int, width: int):
    step = max(1, MATRIX_CELLS // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _boxes(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of boxes of at most `size` points, halved at the median of their widest side."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        some = points[rows]
        wide = some[:, (some.max(axis=0) - some.min(axis=0)).argmax()]
        half = len(rows) // 2
        order = np.argpartition(wide, half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _k_best(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least distances of each row in order; equal ones by column."""
    kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
    row, col = np.nonzero(d2 <= kth[:, None])
    order = np.lexsort((col, d2[row, col], row))
    row, col = row[order], col[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[best], col[best]


def closest(points: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `points`, row of `known`, squared distance) of the k nearest of each point, in the order of points and
    distances; equal distances by the row of `known`. Rows with NaN are near to none."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    asked, given = np.flatnonzero(~np.isnan(points).any(axis=1)), np.flatnonzero(~np.isnan(known).any(axis=1))
    if not len(asked) or len(given) < min(k, len(known)) or not len(given):
        return none
    q, t = points[asked], known[given]
    if not (np.isfinite(q).all() and np.isfinite(t).all()):  # boxes without an end: everything is compared
        boxes, groups = [np.arange(len(t))], [np.arange(len(q))[s] for s in _strips(len(q), len(t))]
    else:
        boxes, groups = _boxes(t, BOX_ROWS), _boxes(q, max(1, min(BOX_ROWS, MATRIX_CELLS // len(t))))
    low, high = (np.array([f(t[b], axis=0) for b in boxes]) for f in (np.min, np.max))
    sizes = np.array([len(b) for b in boxes])
    found = []
    for rows in groups:
        mine, near = q[rows], range(len(boxes))
        if len(boxes) > 1:
            gap = np.maximum(0, np.maximum(low - mine.max(axis=0), mine.min(axis=0) - high))
            least = np.zeros(len(boxes))
            for j in range(gap.shape[1]):  # summed as distances are, so that no rounding puts it above one
                least += gap[:, j] * gap[:, j]
            order = np.argsort(least, kind="stable")
            first = order[:np.searchsorted(np.cumsum(sizes[order]), min(2 * k, len(t))) + 1]
            seen = _squared(mine, t[np.concatenate([boxes[b] for b in first])])
            bound = np.partition(seen, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1].max()
            near = np.flatnonzero(least <= bound)
        cols = np.sort(np.concatenate([boxes[b] for b in near]))
        d2 = _squared(mine, t[cols])
        row, col = _k_best(d2, k)
        found.append((asked[rows[row]], given[cols[col]], d2[row, col]))
    row, col, d2 = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], d2[order]


def _nearest_in(q: pa.Table, t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    t = t.take(pc.sort_indices(t, sort_keys=[("tid", "ascending")]))
    return *closest(_matrix(q["v"]), _matrix(t["v"]), k), t


def nearest(queries: DataFrame, train: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, rank, d2, tid, y): the k training rows closest to every query; equal distances by `tid`.

    `queries` is (qid string, v array<double>), `train` is (tid string, v array<double>, y double). Vectors should be whole: with
    several cells, training points that share a cell with one that has a missing number are not found."""
    queries, n_train = queries.select("qid", "v"), train.count()
    n_pivots = min(MAX_PIVOTS, math.ceil(n_train / block_rows))
    chosen = train.select("v", row_hash(train["tid"], "pivot").alias("h"), "tid").orderBy("h", "tid").limit(n_pivots)
    pivots = np.array([r["v"] for r in chosen.collect()], dtype="float64") if n_pivots > 1 else np.zeros((n_pivots, 0))  # at most MAX_PIVOTS rows
    n_pivots = len(pivots)

    def to_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add the nearest pivot and its distance."""
        for b in batches:
            if b.num_rows:
                points = _matrix(b["v"])
                cell, reach = np.zeros(len(points), dtype="int32"), np.zeros(len(points))
                for s in _strips(len(points), len(pivots)):
                    d2 = _squared(points[s], pivots)
                    cell[s], reach[s] = d2.argmin(axis=1), np.sqrt(d2.min(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(reach)], names=[*b.schema.names, "cell", "reach"])

    if n_pivots > 1:
        # Of training points that coincide only the first k can ever be neighbours: a point shared by many
        # rows shrinks to k before it is shuffled.
        copy_no = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("tid"))  # a hash sorts faster than an array
        train = train.withColumn("copy_no", copy_no).where(F.col("copy_no") <= k).drop("copy_no")
        cells = (train.select("tid", "v", "y").mapInArrow(to_cell, "tid string, v array<double>, y double, cell int, reach double"),
                 queries.mapInArrow(to_cell, "qid string, v array<double>, cell int, reach double"))
        placed, at_home = together(train.sparkSession, [partial(stage, c) for c in cells], 2)
    else:
        # renamed, as both sides may be parts of one table
        placed = train.select(*[F.col(c).alias(c) for c in ("tid", "v", "y")], F.lit(0).alias("cell"), F.lit(0.0).alias("reach"))
        at_home = queries.select("qid", "v", F.lit(0).alias("cell"))
    size, radius = np.zeros(max(1, n_pivots), dtype="int64"), np.zeros(max(1, n_pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect():  # a row per pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    # A missing number has no distance to a pivot, so the cell of such points has no radius and is never visited.
    lost = np.isnan(radius)
    if lost.any() and size[~lost].sum() < k:
        lost[:] = True
    placed = placed.where(~F.col("cell").isin(*np.flatnonzero(lost).tolist())) if lost.any() else placed
    blocks = np.maximum(1, -(-size // block_rows))
    n_blocks = _lookup(dict(enumerate(blocks.tolist())))
    at_home = at_home.select("qid", "v", "cell", F.pmod(F.xxhash64("qid"), n_blocks).cast("int").alias("block"))

    def met(visits: DataFrame, meet, schema: str) -> DataFrame:
        """`meet` on each group of visitors (qid, v, cell, block, ...) and the block that they visit."""
        keys = ["cell", "block", "part"]
        seen = {(r["cell"], r["block"]): math.ceil(r["n"] / block_rows) for r in visits.groupBy("cell", "block").agg(F.count("*").alias("n")).collect()}
        if not seen:
            return visits.sparkSession.createDataFrame([], schema)
        most: dict[int, int] = {}  # groups of the busiest block of a cell
        for (cell, _), n in seen.items():
            most[cell] = max(n, most.get(cell, 1))
        n_groups = _lookup(most)
        left = visits.withColumn("part", F.pmod(F.xxhash64("qid"), n_groups).cast("int"))
        right = placed.where(F.col("cell").isin(*most)).select(
            "tid", "v", "y", "cell", F.pmod(F.xxhash64("tid"), n_blocks).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), n_groups - 1)).alias("part"))
        n = min(MAX_PARTS, 2 * sum(most[c] * int(blocks[c]) for c in most))
        return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(meet, schema)

    def ask_home(q: pa.Table, t: pa.Table) -> pa.Table:
        """The nearest in the block, of each query, and how far the last of k is."""
        row, col, d2, t = _nearest_in(q, t, k)
        ends = np.searchsorted(row, np.arange(len(q) + 1))
        bound = np.full(len(q), np.inf)
        full = np.flatnonzero(np.diff(ends) == k)
        bound[full] = d2[ends[full + 1] - 1]
        near = pa.StructArray.from_arrays([pa.array(d2), *(t[c].take(pa.array(col)).combine_chunks() for c in ("tid", "y"))], names=["d2", "tid", "y"])
        points = _matrix(q["v"])  # made anew, as the numbers of a vector's array are declared not to be null
        v = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * points.shape[1], points.ravel())
        return pa.Table.from_arrays([q["qid"], v, q["cell"], q["block"], pa.array(bound), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)],
                                    names=["qid", "v", "cell", "block", "bound", "near"])

    home = met(at_home, ask_home, "qid string, v array<double>, cell int, block int, bound double, near array<struct<d2: double, tid: string, y: double>>")
    if n_pivots > 1:
        home = stage(home)
    found = home.select("qid", F.inline("near"))

    def to_visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that can hold a point as near as the k nearest so far."""
        between = np.sqrt(_squared(pivots, pivots))
        for b in batches:
            if not b.num_rows:
                continue
            points, own, last = _matrix(b["v"]), b["cell"].to_numpy(), np.sqrt(b["bound"].to_numpy())
            for s in _strips(len(points), len(pivots)):
                d2 = _squared(points[s], pivots)
                d, mine, here = np.sqrt(d2), own[s], np.arange(len(d2))
                # before k are known, from the distance to every pivot and the radius of its cell
                upper = np.where(size > 0, d + radius, np.inf)
                order = np.argsort(upper, axis=1)
                enough = np.cumsum(size[order], axis=1) >= k
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(pivots) - 1)
                bound = np.take_along_axis(upper, np.take_along_axis(order, at[:, None], 1), 1)
                bound = np.minimum(np.where(enough.any(axis=1)[:, None], bound, np.inf), last[s][:, None])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d2 - d2[here, mine][:, None] - SLACK * (d2 + radius ** 2)) / (2 * between[mine])
                lower = np.maximum(d - radius, np.where(between[mine] > 0, plane, -np.inf))
                row, cell = np.nonzero((size > 0) & (lower <= bound + SLACK * (1.0 + d)) & ((blocks > 1) | (np.arange(len(pivots)) != mine[:, None])))
                part = b.slice(s.start, len(d2)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("qid", "v", "bound")), part["cell"], part["block"], pa.array(cell.astype("int32"))],
                                                 names=["qid", "v", "bound", "from_cell", "from_block", "cell"])

    def ask(q: pa.Table, t: pa.Table) -> pa.Table:
        row, col, d2, t = _nearest_in(q, t, k)
        near = d2 <= q["bound"].to_numpy()[row]
        row, col = pa.array(row[near]), pa.array(col[near])
        return pa.Table.from_arrays([q["qid"].take(row), pa.array(d2[near]), t["tid"].take(col), t["y"].take(col)], names=["qid", "d2", "tid", "y"])

    if n_pivots > 1:
        cells = home.select("qid", "v", "bound", "cell", "block").mapInArrow(
            to_visits, "qid string, v array<double>, bound double, from_cell int, from_block int, cell int")
        visits = cells.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).where("cell != from_cell OR block != from_block")
        found = found.unionByName(met(stage(visits.select("qid", "v", "bound", "cell", "block")), ask, "qid string, d2 double, tid string, y double"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "tid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "d2", "tid", "y")


def _lookup(values: dict[int, int]):
    return F.create_map(*[F.lit(v) for item in values.items() for v in item])[F.col("cell")]


def mean_of_neighbours(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("qid").agg(F.avg("y").alias("prediction"))


def vote_of_neighbours(neighbours: DataFrame, n_classes: int) -> DataFrame:
    """The most frequent class (the smallest of equals) and the share of every class."""
    shares = neighbours.groupBy("qid").agg(F.collect_list("y").alias("ys")).select(
        "qid", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.size(
            F.filter("ys", lambda y: y == c)) / F.size("ys")).alias("probability"))
    return shares.select(
        "qid", (F.array_position("probability", F.array_max("probability")) - 1).cast("double").alias("prediction"),
        "probability")
