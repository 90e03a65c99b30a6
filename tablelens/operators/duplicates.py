"""Counting repeated rows without shuffling whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import field_type, present

#: Hashes met more than once are broadcast up to this many.
BROADCAST_HASHES = 2_000_000


def _comparable(df: DataFrame) -> list[Column]:
    out = []
    for name in df.columns:
        dtype = field_type(df, name)
        c = present(name, dtype)
        if isinstance(dtype, (T.MapType, T.VariantType)):
            c = F.to_json(c)
        out.append(c.alias(f"c{len(out)}"))
    return out


def count_duplicates(df: DataFrame) -> tuple[int, int]:
    """(rows, later copies of rows whose columns all agree, NULL equal to NULL).

    Rows are first grouped by a 64-bit hash. Only hashes met more than once can hold copies; the rows
    behind them are grouped by their full content, which also separates rows that merely collide."""
    rows = df.select(*_comparable(df))
    columns = [F.col(c) for c in rows.columns]
    hashed = rows.withColumn("h", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    by_hash = hashed.groupBy("h").agg(F.count("*").alias("cnt"))
    totals = by_hash.agg(
        F.sum("cnt").alias("n_rows"),
        F.count_if(F.col("cnt") == 1).alias("single"),
        F.count_if(F.col("cnt") > 1).alias("suspect"),
    ).first()
    n_rows = totals["n_rows"] or 0
    if totals["suspect"] == 0:
        return n_rows, 0
    if totals["suspect"] > BROADCAST_HASHES:
        # So many repeats that most rows would travel anyway; copies meet before the shuffle.
        return n_rows, n_rows - rows.distinct().count()
    suspects = F.broadcast(by_hash.where(F.col("cnt") > 1).select("h"))
    distinct_rows = hashed.join(suspects, "h", "left_semi").select(*rows.columns).distinct().count()
    return n_rows, n_rows - totals["single"] - distinct_rows


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_duplicated)."""
    return df.sparkSession.createDataFrame([count_duplicates(df)], "n_rows bigint, n_duplicated bigint")
