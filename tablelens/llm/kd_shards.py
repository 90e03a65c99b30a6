"""K-d tree sharding at distributed weighted medians. DataFrame functions only.

All documents begin in one cell that is to become `shards` leaves. Level by level every cell with more than one leaf to
come is cut along its widest metadata dimension (widths are relative to the whole table's) into a part with the lower
half of the leaves and one with the rest, at the place where the bytes divide in that ratio. Documents of a cell are in
the order of (coordinate, checksum of the text, hash of the id), so equal texts are neighbours and ties of any size can
be cut. The place is found exactly by radix selection: the order is read as digits of 12 bits or fewer, and each
round sums the bytes per (cell, next digit) of the documents that agree with the digits found so far; only those sums,
4,096 a cell at most, reach the driver. One task never holds a cell.

Defined cases: a NULL text has no bytes and the checksum of an empty one; a NULL in a dimension counts as the lowest
coordinate; repeated rows that agree in id and text are not told apart, so they stay together; other columns are
ignored; fewer documents than shards leave shards empty. No documents give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

COORDINATE_BITS, HASH_BITS = 12, 36
#: (key, bits to the right of the digit, bits of the digit), the most significant digit first.
DIGITS = (("ka", 32, 12), ("ka", 20, 12), ("ka", 8, 12), ("ka", 0, 8), ("kb", 24, 12), ("kb", 12, 12), ("kb", 0, 12))
#: Rows numbered by one task.
SLOT_ROWS = 50_000


def document_dimensions() -> dict[str, Column]:
    """Metadata of `documents` as coordinates: size on a log scale, and the places of source and language."""
    return {"size": F.log2(F.col("size").cast("double")), "source": F.crc32(F.col("source").cast("binary")).cast("double"),
            "lang": F.crc32(F.col("lang").cast("binary")).cast("double")}


def _per_cell(values: dict[int, Column | float | int], otherwise: Column) -> Column:
    out = otherwise
    for cell, value in values.items():
        out = F.when(F.col("cell") == cell, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    dimensions = document_dimensions() if dimensions is None else dimensions
    base = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8,
                             "crc": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    names = [f"c{i}" for i in range(len(dimensions))]
    rows = stage(base.select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "crc", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS).alias("kb"),
        *[F.coalesce(c, F.lit(-1.0)).alias(n) for n, c in zip(names, dimensions.values())], F.lit(0).alias("cell")))
    leaves = {0: shards}  # of each cell, by its first leaf
    whole: dict[str, float] = {}
    while any(k > 1 for k in leaves.values()):
        extents = rows.where(F.col("cell").isin([c for c, k in leaves.items() if k > 1])).groupBy("cell").agg(
            F.sum("size").alias("bytes"), *[f(n).alias(f"{p}_{n}") for n in names for p, f in (("lo", F.min), ("hi", F.max))]).collect()
        if not extents:
            break
        if not whole:
            whole = {n: (extents[0][f"hi_{n}"] - extents[0][f"lo_{n}"]) or 1.0 for n in names}
        rows, cuts = _cuts(rows, extents, leaves, names, whole)
        rows = rows.withColumn("cell", _per_cell({
            c: F.when(left, F.lit(c)).otherwise(F.lit(c + leaves[c] // 2)) for c, left in cuts.items()}, F.col("cell"))).drop("ka")
        for c in [c for c, k in leaves.items() if k > 1]:
            half = leaves[c] // 2
            leaves[c], leaves[c + half] = half, leaves[c] - half
    return _slots(rows)


def _cuts(rows: DataFrame, extents: list, leaves: dict[int, int], names: list[str], whole: dict[str, float]) -> tuple[DataFrame, dict[int, Column]]:
    """The rows with `ka`, the upper part of their place in their cell's order, and per cell the condition for its lower part."""
    quantised, target = {}, {}
    top = (1 << COORDINATE_BITS) - 1
    for e in extents:
        width = {n: (e[f"hi_{n}"] - e[f"lo_{n}"]) / whole[n] for n in names}
        n = max(names, key=lambda x: width[x])
        span = (e[f"hi_{n}"] - e[f"lo_{n}"]) or 1.0
        quantised[e["cell"]] = F.floor((F.col(n) - e[f"lo_{n}"]) / span * top).cast("long")
        target[e["cell"]] = e["bytes"] * (leaves[e["cell"]] // 2) / leaves[e["cell"]]
    ka = F.shiftleft(_per_cell(quantised, F.lit(0).cast("long")), 32).bitwiseOR(F.col("crc"))
    rows = stage(rows.withColumn("ka", ka))
    known = {c: {"ka": (0, 44), "kb": (0, HASH_BITS), "base": 0, "low": True} for c in target}  # (prefix, bits not yet known)
    running = sorted(target)
    for key, shift, bits in DIGITS:
        if not running:
            break
        agrees = F.lit(True)
        for k in ("ka", "kb"):  # all cells still running know the same number of digits
            prefix = F.create_map(*[F.lit(x) for c in running for x in (c, known[c][k][0])])
            agrees = agrees & (F.shiftright(k, known[running[0]][k][1]) == F.try_element_at(prefix, F.col("cell")))
        digit = F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1))
        sums = rows.where(agrees).groupBy("cell", digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        for c in list(running):
            mine = sorted((r["digit"], r["bytes"], r["n"]) for r in sums if r["cell"] == c)
            at = known[c]["base"]
            for d, size, n in mine:
                if at + size >= target[c] or d == mine[-1][0]:
                    break
                at += size
            # the documents of this digit go where that leaves the cut nearer to its target, once they are not divided further
            known[c] |= {key: ((known[c][key][0] << bits) | d, shift), "base": at, "low": at + size / 2 <= target[c]}
            if n == 1 or at + size == target[c]:
                running.remove(c)
    left = {}
    for c, f in known.items():
        (pa, ra), (pb, rb) = f["ka"], f["kb"]
        a, b = F.shiftright("ka", ra), F.shiftright("kb", rb)
        left[c] = (a < pa) | ((a == pa) & ((b < pb) | ((b == pb) & F.lit(f["low"]))))
    return rows, left


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers within each shard: rows are numbered within buckets of bounded size, and the buckets' sizes added up."""
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, math.ceil(max(counts.values(), default=1) / SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(buckets)))
    sizes = rows.groupBy("cell", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("cell", "bucket", F.coalesce(before, F.lit(0)).alias("before"))  # one row per 50,000 documents or so
    own = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("doc_id", "crc"))
    numbered = rows.withColumn("own", own)
    return numbered.join(offsets, ["cell", "bucket"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.col("cell").alias("shard"), (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))
