"""Exact linear-interpolated quantiles without a sort and without holding a column in one task.

Small columns use the built-in exact aggregate. For the others a bounded sketch brackets every wanted
rank, one pass counts what lies below each bracket, and only the values inside the brackets (a fixed
small share of the rows) are grouped and ranked. The bracket is verified by counting, so the answer is
exact whatever the sketch returned.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

#: Columns with at most this many values may be held in one aggregation buffer.
SMALL_COLUMN = 100_000
#: Values all buffers of one aggregate may hold together.
SMALL_TOTAL = 4_000_000
#: Distinct values of one bracket that a single task may rank.
BRACKET_ROWS = 1_000_000
#: Relative error of the bracketing sketch is 1 / SKETCH_ACCURACY.
SKETCH_ACCURACY = 4_000
NARROWING_BINS = 1_000
LARGEST = sys.float_info.max / 4
QUARTILES = (0.25, 0.5, 0.75)
#: Expressions put into one aggregate.
AGGREGATE_WIDTH = 120


@dataclass(frozen=True)
class _Slot:
    """One order-statistic search: rank `first` (from 0) and the next one, inside [low, high]."""

    name: str
    first: int
    second: int
    weight: float
    low: float
    high: float


def _bracket_probabilities(probs: tuple[float, ...], accuracy: int) -> list[float]:
    reach = 4.0 / accuracy
    return [p for q in probs for p in (max(0.0, q - reach), min(1.0, q + reach))]


def bracket_sketch(x: Column, probs: tuple[float, ...] = QUARTILES, accuracy: int = SKETCH_ACCURACY) -> Column:
    """Aggregate giving a (low, high) bracket per probability, to be computed along with other statistics."""
    return F.percentile_approx(x, _bracket_probabilities(probs, accuracy), accuracy)


def _chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def exact_quantiles(
    df: DataFrame,
    exprs: dict[str, Column],
    counts: dict[str, int],
    brackets: dict[str, list[float] | None] | None = None,
    probs: tuple[float, ...] = QUARTILES,
    *,
    small: int = SMALL_COLUMN,
    accuracy: int = SKETCH_ACCURACY,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of every expression. `counts` holds its number of non-NULL values, `brackets` what
    `bracket_sketch` returned for it (computed here for columns that lack one and need it)."""
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in exprs if counts[n] == 0}
    little = [n for n in exprs if 0 < counts[n] <= small]
    large = [n for n in exprs if counts[n] > small]

    if little:
        width = max(1, min(AGGREGATE_WIDTH, SMALL_TOTAL // max(counts[n] for n in little)))
        for chunk in _chunks(little, width):
            row = df.agg(*[F.percentile(exprs[n], list(probs)).alias(f"q{i}") for i, n in enumerate(chunk)]).first()
            out.update({n: [float(v) for v in row[i]] for i, n in enumerate(chunk)})

    if large:
        known = dict(brackets or {})
        for chunk in _chunks([n for n in large if not known.get(n)], AGGREGATE_WIDTH):
            row = df.agg(*[bracket_sketch(exprs[n], probs, accuracy).alias(f"b{i}") for i, n in enumerate(chunk)]).first()
            known.update({n: row[i] for i, n in enumerate(chunk)})
        slots = []
        for n in large:
            for j, p in enumerate(probs):
                h = (counts[n] - 1) * p
                first = math.floor(h)
                slots.append(_Slot(n, first, min(first + 1, counts[n] - 1), h - first,
                                   float(known[n][2 * j]), float(known[n][2 * j + 1])))
        values = []
        for chunk in _chunks(slots, AGGREGATE_WIDTH):
            values += _select(df, exprs, chunk, bracket_rows)
        for i, n in enumerate(large):
            out[n] = values[i * len(probs) : (i + 1) * len(probs)]
    return out


def _select(df: DataFrame, exprs: dict[str, Column], slots: list[_Slot], bracket_rows: int) -> list[float]:
    names = list(dict.fromkeys(s.name for s in slots))
    values = df.select(*[exprs[n].alias(f"x{i}") for i, n in enumerate(names)])
    x = [F.col(f"x{names.index(s.name)}") for s in slots]

    spans = [(s.low, s.high) for s in slots]
    below, inside = _span_counts(values, x, spans)
    pair: dict[int, tuple[float, float]] = {}
    for i, s in enumerate(slots):
        if not (below[i] <= s.first and s.second < below[i] + inside[i]):
            # Never expected; the whole range is always right.
            spans[i], below[i], inside[i] = (-math.inf, math.inf), 0, bracket_rows + 1
        elif s.low == s.high:
            pair[i] = (s.low, s.low)
    open_slots = [i for i in range(len(slots)) if i not in pair]
    if open_slots:
        pair.update(_rank_inside(values, x, slots, spans, below, inside, open_slots, bracket_rows))
    out = []
    for i, s in enumerate(slots):
        a, b = pair[i]
        out.append(a if a == b else a + (b - a) * s.weight)
    return out


def _rank_inside(
    values: DataFrame, x: list[Column], slots: list[_Slot], spans: list[tuple[float, float]],
    below: list[int], inside: list[int], open_slots: list[int], bracket_rows: int,
) -> dict[int, tuple[float, float]]:
    """Group the values inside the open brackets and look the wanted ranks up."""
    in_span = {i: x[i].between(F.lit(spans[i][0]), F.lit(spans[i][1])) for i in open_slots}
    some = reduce(lambda a, b: a | b, in_span.values())
    cells = values.where(some).select(*[F.when(c, x[i]).alias(str(i)) for i, c in in_span.items()])
    found = (
        cells.unpivot([], list(cells.columns), "slot", "x").where(F.col("x").isNotNull())
        .select(F.col("slot").cast("int").alias("slot"), "x").groupBy("slot", "x").agg(F.count("*").alias("cnt"))
    )
    pair: dict[int, tuple[float, float]] = {}
    if max(inside[i] for i in open_slots) > bracket_rows:
        found, below, pair = _narrow(found, slots, below, bracket_rows)

    ranks = _by_slot({i: s.first - below[i] for i, s in enumerate(slots)})
    nexts = _by_slot({i: s.second - below[i] for i, s in enumerate(slots)})
    upto = F.sum("cnt").over(Window.partitionBy("slot").orderBy("x"))
    rows = (
        found.withColumn("upto", upto)
        .groupBy("slot")
        .agg(F.min(F.when(F.col("upto") > ranks, F.col("x"))).alias("a"),
             F.min(F.when(F.col("upto") > nexts, F.col("x"))).alias("b"))
        .collect()
    )
    pair.update({r["slot"]: (r["a"], r["b"]) for r in rows})
    return pair


def _span_counts(values: DataFrame, x: list[Column], spans: list[tuple[float, float]]) -> tuple[list[int], list[int]]:
    aggs = []
    for i, (lo, hi) in enumerate(spans):
        aggs += [F.count_if(x[i] < F.lit(lo)).alias(f"l{i}"),
                 F.count_if(x[i].between(F.lit(lo), F.lit(hi))).alias(f"m{i}")]
    row = values.agg(*aggs).first()
    return [row[f"l{i}"] for i in range(len(spans))], [row[f"m{i}"] for i in range(len(spans))]


def _narrow(
    found: DataFrame, slots: list[_Slot], below: list[int], bracket_rows: int
) -> tuple[DataFrame, list[int], dict[int, tuple[float, float]]]:
    """Shrink the brackets that still hold too many distinct values by counting equal-width bins.

    Two wanted ranks that fall into different bins are the last value of one and the first of the
    other, so such a search is over at once; otherwise one bin remains."""
    found = stage(found)
    below = list(below)
    solved: dict[int, tuple[float, float]] = {}
    before: dict = {}
    while True:
        sizes = found.groupBy("slot").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        wide = {r["slot"]: r for r in sizes if r["n"] > bracket_rows and r["lo"] < r["hi"]}
        if not wide or wide == before:  # infinities and neighbouring doubles cannot be told apart further
            return found, below, solved
        before = wide
        slot, x = F.col("slot"), F.col("x")
        lows = {i: _bounded(r["lo"]) for i, r in wide.items()}
        steps = {i: _bounded(r["hi"]) / NARROWING_BINS - lows[i] / NARROWING_BINS for i, r in wide.items()}
        place = F.floor((x - _by_slot(lows)) / _by_slot(steps))
        binned = found.withColumn("bin", F.when(
            slot.isin(*wide), F.greatest(F.lit(0), F.least(place, F.lit(NARROWING_BINS - 1)))))
        totals = (
            binned.where(F.col("bin").isNotNull())
            .groupBy("slot", "bin").agg(F.sum("cnt").alias("cnt"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .withColumn("upto", F.sum("cnt").over(Window.partitionBy("slot").orderBy("bin")))
            .collect()  # at most NARROWING_BINS rows per slot
        )
        keep: dict[int, int] = {}
        for i in wide:
            mine = sorted((r for r in totals if r["slot"] == i), key=lambda r: r["bin"])
            one = next(r for r in mine if r["upto"] > slots[i].first - below[i])
            two = next(r for r in mine if r["upto"] > slots[i].second - below[i])
            if one["bin"] != two["bin"]:
                solved[i] = (one["hi"], two["lo"])
                keep[i] = -1
            else:
                keep[i] = one["bin"]
                below[i] += one["upto"] - one["cnt"]
        found = stage(
            binned.where(F.col("bin").isNull() | (F.col("bin") == _by_slot(keep))).select("slot", "x", "cnt"))


def _bounded(v: float) -> float:
    """v within half the range of doubles, so that differences stay finite."""
    return max(-LARGEST, min(LARGEST, float(v)))


def _by_slot(values: dict[int, float]) -> Column:
    """A literal lookup from slot number to a value."""
    return F.try_element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), F.col("slot"))
