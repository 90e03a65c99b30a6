"""Value frequencies of many columns in one shuffle of (column, value) pairs."""

from __future__ import annotations

import datetime
import decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    FLOAT_TYPES, INTEGRAL_TYPES, TIME_TYPES, field_type, finite, present, ref, text_to_number,
)
from ..functions.dates import DATE_MARKS, text_to_datetime

#: Longer texts are grouped by their SHA-256 digest, so that whole documents are not shuffled.
LONG_TEXT = 256
DIGEST_MARK = "sha256:"

KEY_TYPES = {"i": "bigint", "d": "double", "m": "decimal(38,18)", "s": "string"}

#: Columns expanded together; wide tables are read in several such groups.
EXPANDED_COLUMNS = 64

#: Values shown per column.
N_SAMPLES = 5


def _wall_clock_micros(value: Column) -> Column:
    """Microseconds of a zoneless timestamp since 1970, without passing through a time zone."""
    day = F.unix_date(value.cast("date")).cast("bigint")
    minutes = (F.hour(value) * 60 + F.minute(value)).cast("bigint")
    second = (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    return (day * 1440 + minutes) * 60_000_000 + second


def cell_kind(dtype: T.DataType) -> str:
    """Which typed key a column is grouped by: i(ntegral and time), d(ouble), m for decimals, or s(tring). Decimals
    that no key of 38 digits holds exactly are grouped as text."""
    if isinstance(dtype, T.DecimalType):
        return "m" if dtype.scale <= 18 and dtype.precision - dtype.scale <= 20 else "s"
    if isinstance(dtype, INTEGRAL_TYPES + TIME_TYPES + (T.BooleanType,)):
        return "i"
    return "d" if isinstance(dtype, FLOAT_TYPES) else "s"


def cell_key(name: str, dtype: T.DataType) -> Column:
    """The grouping key of a cell, NULL for a missing one. Each kind keeps its own order and equality."""
    kind = cell_kind(dtype)
    if kind == "d":
        return present(name, dtype).cast("double")
    if kind == "m":
        return ref(name).cast(KEY_TYPES["m"])
    if kind == "s":
        text = ref(name).cast("string")
        return F.when(F.octet_length(text) <= LONG_TEXT, text).otherwise(
            F.concat(F.lit(DIGEST_MARK), F.sha2(text, 256)))
    if isinstance(dtype, T.DateType):
        return F.unix_date(ref(name)).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(ref(name))
    if isinstance(dtype, T.TimestampNTZType):
        return _wall_clock_micros(ref(name))
    return ref(name).cast("bigint")


def frequency_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, i, d, m, s, cnt): how often every present value of every named column occurs. `col` is the
    position in `names`.

    Columns of one kind are expanded together and grouped by (col, value) with map-side counts, so a hot
    value costs nothing and each scan reads only the columns of its kind."""
    parts = []
    for kind in KEY_TYPES:
        mine = [(k, n) for k, n in enumerate(names) if cell_kind(field_type(df, n)) == kind]
        for i in range(0, len(mine), EXPANDED_COLUMNS):
            wide = df.select(*[cell_key(n, field_type(df, n)).alias(str(k)) for k, n in mine[i : i + EXPANDED_COLUMNS]])
            counted = (
                wide.unpivot([], list(wide.columns), "col", "v").where(F.col("v").isNotNull())
                .select(F.col("col").cast("int").alias("col"), "v").groupBy("col", "v").agg(F.count("*").alias("cnt"))
            )
            keys = [(F.col("v") if k == kind else F.lit(None).cast(t)).alias(k) for k, t in KEY_TYPES.items()]
            parts.append(counted.select("col", *keys, "cnt"))
    return reduce(DataFrame.unionByName, parts)


def frequency_summary(freq: DataFrame) -> DataFrame:
    """Per column: distinct values, whether all finite floats are whole, how many cells read as numbers
    or dates, and the most frequent values (then in value order).

    Text is parsed once per distinct value. The ranking window is pruned to its first rows before the
    shuffle, and both branches use the same columns, so that the big exchanges are built once and reused."""
    s, d, cnt = F.col("s"), F.col("d"), F.col("cnt")
    counts = freq.groupBy("col").agg(
        F.count_if(cnt > 0).alias("n_unique"),
        F.coalesce(F.bool_and(F.when(finite(d), d % 1 == 0)), F.bool_and(F.col("m") % 1 == 0), F.max("i").isNotNull()).alias("all_integral"),
        F.sum(F.when(text_to_number(s).isNotNull(), cnt)).alias("n_number_text"),
        F.sum(F.when(s.rlike(DATE_MARKS), cnt)).alias("n_date_marked"),
        F.sum(F.when(text_to_datetime(s).isNotNull(), cnt)).alias("n_date_parsed"),
    )
    top = (
        freq.withColumn("rn", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("cnt"), "i", "d", "m", "s")))
        .where(F.col("rn") <= N_SAMPLES)
        .groupBy("col")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "i", "d", "m", "s", "cnt"))).alias("top"))
    )
    return counts.join(F.broadcast(top), "col")  # one row per column


def cell_value(dtype: T.DataType, i: int | None, d: float | None, s: str | None, m: decimal.Decimal | None = None):
    """The Python value behind a grouping key."""
    if m is not None:
        return round(m, dtype.scale)
    if isinstance(dtype, T.BooleanType):
        return bool(i)
    if isinstance(dtype, T.DateType):
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=i)
    if isinstance(dtype, TIME_TYPES):
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=i)
    return i if i is not None else d if d is not None else s


def long_texts(df: DataFrame, wanted: dict[str, set[str]]) -> dict[str, str]:
    """The texts behind a handful of digest keys, per column."""
    found: dict[str, str] = {}
    for name, keys in wanted.items():
        key = cell_key(name, field_type(df, name))
        text = ref(name).cast("string")
        rows = (
            df.where(F.octet_length(text) > LONG_TEXT).select(key.alias("k"), text.alias("t"))
            .where(F.col("k").isin(*keys)).groupBy("k").agg(F.first("t").alias("t")).collect()
        )
        found.update({r["k"]: r["t"] for r in rows})
    return found
