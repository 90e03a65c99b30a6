"""Pairwise-complete Pearson correlation as sums per pair of columns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import number_of

#: Up to this many columns the pair sums are plain aggregates inside the JVM.
FEW_COLUMNS = 8
#: Variance below this share of the raw second moment counts as zero.
FLAT = 1e-13
#: Columns that a task multiplies by as many others, and columns whose sums travel in one row.
PANEL, TILE = 512, 64
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_matrix(
    df: DataFrame, names: list[str], location: dict[str, tuple[float | None, float | None]], *, panel: int = PANEL
) -> DataFrame:
    """(ord1, var1, ord2, var2, corr) for every ordered pair; NULL where a column does not vary over
    the rows both have. `location` holds mean and standard deviation, used only to keep sums small. A task holds two
    panels of columns at a time."""
    shifted = df.select(*[_standardised(number_of(df, n), *location[n]).alias(f"x{i}") for i, n in enumerate(names)])
    sums = _sums_in_jvm(shifted, len(names)) if len(names) <= FEW_COLUMNS else _sums_by_panel(shifted, len(names), panel)
    upper = sums.select("i", "j", _corr().alias("corr"))
    both = upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    name = F.array(*[F.lit(n) for n in names])
    return both.select(
        F.col("i").alias("ord1"), name[F.col("i")].alias("var1"),
        F.col("j").alias("ord2"), name[F.col("j")].alias("var2"), "corr",
    )


def _standardised(x: Column, mean: float | None, std: float | None) -> Column:
    centre = mean if mean is not None and math.isfinite(mean) else 0.0
    scale = std if std is not None and math.isfinite(std) and std > 0 else 1.0
    return (x - F.lit(centre)) / F.lit(scale)


def _corr() -> Column:
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    varies = (n > 1) & (vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy"))
    r = (F.col("sxy") - sx * sy / n) / F.sqrt(vx * vy)
    return F.when(varies, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))


def _sums_in_jvm(x: DataFrame, k: int) -> DataFrame:
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    aggs = []
    for i, j in pairs:
        a, b = F.col(f"x{i}"), F.col(f"x{j}")
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        parts = (F.count(a).cast("double"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b))
        aggs.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[p.alias(s) for p, s in zip(parts, SUMS)]))
    return x.agg(F.array(*aggs).alias("pairs")).select(F.inline("pairs"))


def _panel_products(first: range, second: range):
    """Sums of the pairs of two panels of columns over the rows of a task: a row per column of the first panel and tile of the
    second, so that memory is that of two panels however many columns there are."""
    same, n = first == second, len(first)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), n, len(second)))
        for batch in batches:
            # Missing cells arrive as NaN.
            raw = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float64", copy=False)
            mask = ~np.isnan(raw)
            z, m = np.where(mask, raw, 0.0), mask.astype("float64")
            zp, mp, zq, mq = z[:, :n].T, m[:, :n].T, z if same else z[:, n:], m if same else m[:, n:]
            for t, (left, right) in zip(total, ((mp, mq), (zp, mq), (mp, zq), (zp * zp, mq), (mp, zq * zq), (zp, zq))):
                t += left @ right
        for i, column in enumerate(first):
            tiles = [t for t in range(0, len(second), TILE) if second[min(t + TILE, len(second)) - 1] >= column]
            yield pa.RecordBatch.from_pydict({
                "i": pa.array([column] * len(tiles), pa.int32()), "tile": pa.array([second[t] for t in tiles], pa.int32()),
                "sums": pa.array([total[:, i, t:t + TILE].tobytes() for t in tiles], pa.binary())})
    return products


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same column and tile, which follow each other, are added up and taken apart."""
    def pairs(key: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        i, tile = key
        j = np.arange(tile, tile + sums.shape[1])
        keep = j >= i
        return pa.RecordBatch.from_pydict({"i": np.full(keep.sum(), i, np.int32), "j": j[keep].astype(np.int32)} |
                                          {s: row[keep] for s, row in zip(SUMS, sums)})
    key, total = None, None
    for batch in batches:
        for i, tile, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
            sums = np.frombuffer(raw).reshape(len(SUMS), -1)
            if key == (i, tile):
                total += sums
                continue
            if key:
                yield pairs(key, total)
            key, total = (i, tile), sums.copy()
    if key:
        yield pairs(key, total)


def _sums_by_panel(x: DataFrame, k: int, panel: int) -> DataFrame:
    """A tiled Gramian: each pair of column panels reads its own columns, and the tasks' sums are merged tile by tile."""
    panels = [range(a, min(a + panel, k)) for a in range(0, k, panel)]
    if k > TILE:  # few tasks with many rows each: what a task sends grows with the square of the columns, not with its rows
        x = x.coalesce(2 * x.sparkSession.sparkContext.defaultParallelism)
    parts = [x.select(*[f"x{i}" for i in (first if first == second else [*first, *second])]).mapInArrow(
        _panel_products(first, second), "i int, tile int, sums binary") for at, first in enumerate(panels) for second in panels[at:]]
    together = reduce(DataFrame.unionByName, parts)
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    return together.repartition("i", "tile").sortWithinPartitions("i", "tile").mapInArrow(_merged, schema)


def top_correlations(corr: DataFrame, top_n: int = 15) -> DataFrame:
    """The strongest pairs, each once."""
    return (
        corr.where((F.col("ord1") < F.col("ord2")) & F.col("corr").isNotNull())
        .select("var1", "var2", F.round("corr", 4).alias("corr"), "ord1", "ord2")
        .orderBy(F.abs("corr").desc(), "ord1", "ord2").limit(top_n).select("var1", "var2", "corr")
    )


def correlation_heatmap(corr: DataFrame, max_cols: int = 15) -> DataFrame:
    """Cells of the lower triangle over the columns with the largest mean |r| (own column included).

    With more columns than fit, they are arranged by that strength; otherwise in table order."""
    strength = corr.groupBy("ord1", "var1").agg(F.avg(F.abs("corr")).alias("strength"))
    by_strength = Window.orderBy(F.desc_nulls_last("strength"), "ord1")  # one row per column
    ranked = strength.select(
        "ord1", F.row_number().over(by_strength).alias("by_strength"),
        F.row_number().over(Window.orderBy("ord1")).alias("by_order"), F.count("*").over(Window.partitionBy()).alias("n"),
    ).where(F.col("by_strength") <= max_cols)
    place = F.when(F.col("n") > max_cols, F.col("by_strength")).otherwise(F.col("by_order"))
    kept = F.broadcast(ranked.select(F.col("ord1").alias("o"), place.alias("pos")))  # at most max_cols rows
    rows = kept.select(F.col("o").alias("ord1"), F.col("pos").alias("row_no"))
    cols = kept.select(F.col("o").alias("ord2"), F.col("pos").alias("col_no"))
    return (
        corr.join(rows, "ord1").join(cols, "ord2").where(F.col("row_no") > F.col("col_no"))
        .select("row_no", F.col("var1").alias("row_var"), "col_no", F.col("var2").alias("col_var"), "corr")
    )
