"""Ranks and running totals over a whole table without one task seeing all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

#: Rows one task may rank.
BUCKET_ROWS = 200_000
MAX_BUCKETS = 2_000


def sorted_codes(levels: DataFrame, column: str, n_levels: int, *, as_number: bool = False,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(column, code): position of every distinct level in sorted order, from 0.

    Many levels are written range-partitioned first: the written copy fixes which level lies in which
    range, so that ranks can be offset by the sizes of the lower ranges."""
    order = [F.col(column).cast("double"), F.col(column)] if as_number else [F.col(column)]
    if n_levels <= bucket_rows:
        code = F.row_number().over(Window.orderBy(*order)) - 1
        return levels.select(column, code.cast("bigint").alias("code"))
    parts = min(MAX_BUCKETS, math.ceil(n_levels / bucket_rows))
    ranged = stage(
        levels.select(column).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))  # at most MAX_BUCKETS rows
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "part").select(column, (F.col("offset") + within).cast("bigint").alias("code"))


def prefix_sums(rows: DataFrame, order: list[Column], amount: Column, output: str) -> DataFrame:
    """Add the sum of `amount` over all rows earlier in `order`, which no two rows may share. The rows are written by ranges of
    the order; each range is added up by itself and moved on by the ranges before it (a row per range)."""
    ranged = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.withColumn(output, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_range", "_before")


def in_ranges(df: DataFrame, key: str, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `bucket`: an ascending numeric range per row, each of roughly `bucket_rows` rows. The bounds
    are literals, so that recomputed rows always fall into the same range. `df` should be staged."""
    parts = min(MAX_BUCKETS, math.ceil(df.count() / bucket_rows))
    if parts <= 1:
        return df.withColumn("bucket", F.lit(0.0))
    bounds = set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0])
    splits = [-math.inf, *sorted(bounds), math.inf]
    return Bucketizer(splits=splits, inputCol=key, outputCol="bucket", handleInvalid="keep").transform(df)


def descending_totals(
    df: DataFrame, key: str, sums: list[str], *, group: list[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """For distinct keys (per group): `<sum>_to` = total of `sum` over all keys not below this one, and
    `<sum>_next` = the value of `sum` at the next lower key (NULL at the end)."""
    group = group or []
    ranged = in_ranges(df, key, bucket_rows=bucket_rows)
    per_bucket = ranged.groupBy(*group, "bucket").agg(
        *[F.sum(s).alias(f"{s}_all") for s in sums], F.max_by(F.struct(*sums), key).alias("head"))
    by_bucket = Window.partitionBy(*group).orderBy(F.desc("bucket"))  # at most MAX_BUCKETS rows per group
    higher = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group, "bucket", *[F.coalesce(F.sum(f"{s}_all").over(higher), F.lit(0)).alias(f"{s}_before") for s in sums],
        F.lead("head").over(by_bucket).alias("head"),
    )
    w = Window.partitionBy(*group, "bucket").orderBy(F.desc(key))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(offsets if group else F.broadcast(offsets), [*group, "bucket"])
    return out.select(
        *df.columns,
        *[(F.col(f"{s}_before") + F.sum(s).over(running)).alias(f"{s}_to") for s in sums],
        *[F.coalesce(F.lead(s).over(w), F.col(f"head.{s}")).alias(f"{s}_next") for s in sums],
    )
