"""Seeded hold-out splits and folds with exact sizes, without sorting or shuffling the table.

Rows are ordered by a hash of their key. A part is a range of that order, so only the hash values at
the range ends are needed: rows are counted per hash bucket, and just the buckets that contain an end
are ranked. Assigning rows is then a comparison with those values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..functions.staging import stage
from .ranking import prefix_sums

#: Rows of one hash bucket that a task ranks.
BUCKET_ROWS = 50_000
#: Buckets are the leading hexadecimal digits of the hash; at most this many.
MAX_BUCKET_DIGITS = 5
#: Classes whose range ends may be broadcast, and classes that one task may put in order.
BROADCAST_CLASSES, ORDERED_CLASSES = 200_000, 1_000
SMALL_SAMPLE = 30

#: A row where a part ends, and how many parts end there (those after the first are empty).
END = "struct<h:string,k:string,times:bigint>"


def row_key(key_columns: list[str]) -> Column:
    """The identity of a row as text. With several columns separators inside values are escaped and
    missing values marked, so that different keys stay different."""
    if len(key_columns) == 1:
        return ref(key_columns[0]).cast("string")
    parts = []
    for k in key_columns:
        escaped = F.replace(F.replace(ref(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        parts.append(F.coalesce(escaped, F.lit("\\0")))
    return F.concat_ws("|", *parts)


def row_hash(key: Column, salt: str) -> Column:
    """md5(salt|key) in hexadecimal: the same order in every engine."""
    return F.md5(F.concat_ws("|", F.lit(salt), key))


def holdout_fraction(n_rows: int, fraction: float) -> float:
    """Small samples keep between a fifth and three tenths for testing."""
    return max(0.2, min(0.3, fraction)) if n_rows < SMALL_SAMPLE else fraction


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


@dataclass(frozen=True)
class Parts:
    """How to number the parts of a table: `ends` per class, or one literal list for all rows."""

    salt: str
    key_columns: list[str]
    label: str | None
    ends: DataFrame | None
    literal: list[tuple[str, str]]
    broadcast: bool = True

    def assign(self, df: DataFrame, output: str) -> DataFrame:
        """Add the part number, from 0."""
        key = row_key(self.key_columns)
        me = F.struct(row_hash(key, self.salt).alias("h"), key.alias("k"))
        if self.label is None:
            passed = [F.when(me > F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")), 1).otherwise(0) for h, k in self.literal]
            return df.withColumn(output, sum(passed, F.lit(0)).cast("int"))
        ends = F.broadcast(self.ends) if self.broadcast else self.ends
        own = df.withColumn("_me", me).join(ends, ref(self.label).eqNullSafe(F.col("_class")), "left")
        passed = F.filter(F.coalesce("_ends", F.array().cast(f"array<{END}>")), lambda e: F.struct(e["h"], e["k"]) < F.col("_me"))
        number = F.aggregate(passed, F.coalesce("_none", F.lit(0).cast("bigint")), lambda n, e: n + e["times"])
        return own.select(*[ref(c) for c in df.columns], number.cast("int").alias(output))


def cut_plain(df: DataFrame, key_columns: list[str], salt: str, sizes: list[int]) -> Parts:
    """Consecutive parts of the given sizes (the last one takes the rest)."""
    cuts = [sum(sizes[: i + 1]) for i in range(len(sizes) - 1)]
    one = df.sparkSession.createDataFrame([(0, cuts)], "_class int, cuts array<bigint>")
    rows = _find_ends(df.withColumn("_class", F.lit(0)), "_class", one, key_columns, salt, sum(sizes), True).collect()
    ends = sorted((e["h"], e["k"]) for r in rows for e in r["_ends"] or [] for _ in range(e["times"]))
    return Parts(salt, key_columns, None, None, ends)


def cut_by_class(
    df: DataFrame, label: str, cuts: DataFrame, key_columns: list[str], salt: str, n_rows: int, n_classes: int
) -> Parts:
    """Consecutive parts within every class; `cuts` is (_class, cuts) with the rank of each part's end."""
    few = n_classes <= BROADCAST_CLASSES
    # Staged, as every use of the parts reads it again.
    ends = stage(_find_ends(df, label, cuts, key_columns, salt, n_rows, few))
    return Parts(salt, key_columns, label, ends, [], broadcast=few)


def _find_ends(
    df: DataFrame, label: str, cuts: DataFrame, key_columns: list[str], salt: str, n_rows: int, few_classes: bool
) -> DataFrame:
    """(_class, _ends, _none): the (hash, key) of the rows whose rank within their class is a cut, and how many parts at the
    beginning have no row."""
    small = F.broadcast if few_classes else (lambda x: x)
    digits = min(MAX_BUCKET_DIGITS, max(0, math.ceil(math.log(max(n_rows, 1) / BUCKET_ROWS, 16))))
    key = row_key(key_columns)
    rows = df.select(ref(label).alias("_class"), row_hash(key, salt).alias("h"), key.alias("k")).withColumn(
        "bucket", F.substring("h", 1, digits))
    order = Window.partitionBy("_class").orderBy("bucket")
    counted = rows.groupBy("_class", "bucket").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    every = cuts.select("_class", F.explode("cuts").alias("cut")).groupBy("_class", "cut").agg(F.count("*").alias("times"))
    wanted = every.where(F.col("cut") > 0)
    # One row per class and bucket that holds a cut, with the ranks of the cuts in it.
    targets = stage(
        counted.join(small(wanted), "_class").where(F.col("cut").between(F.col("upto") - F.col("n") + 1, F.col("upto")))
        .groupBy("_class", "bucket").agg(F.map_from_entries(F.collect_list(F.struct(
            (F.col("cut") - F.col("upto") + F.col("n")).cast("int"), "times"))).alias("ranks"))
    )
    rank = F.row_number().over(Window.partitionBy("_class", "bucket").orderBy("h", "k"))
    hits = rows.join(small(targets), ["_class", "bucket"]).withColumn("times", F.element_at("ranks", rank))
    ends = hits.where("times IS NOT NULL").groupBy("_class").agg(F.collect_list(F.struct("h", "k", "times")).alias("_ends"))
    none = every.where(F.col("cut") <= 0).select("_class", F.col("times").alias("_none"))
    return ends.join(none, "_class", "full").select("_class", "_ends", "_none")


# -- the four splits -----------------------------------------------------------------------------------
def holdout_split(df: DataFrame, key_columns: list[str], n_rows: int, *, fraction: float = 0.2, seed: int = 42) -> Parts:
    """Part 0 is the test set: the first ceil(n * fraction) rows in hash order; part 1 the rest."""
    n_test = math.ceil(n_rows * holdout_fraction(n_rows, fraction))
    return cut_plain(df, key_columns, f"{seed}", [n_test, n_rows - n_test])


def kfold(df: DataFrame, key_columns: list[str], n_rows: int, k: int, *, seed: int = 42) -> Parts:
    """k parts whose sizes differ by at most one, larger ones first."""
    return cut_plain(df, key_columns, f"{seed}f", fold_sizes(n_rows, k))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(ref(label).alias("_class")).agg(F.count("*").alias("n"))


def _before(sizes: DataFrame, n_classes: int, order: list[Column], amount: Column, output: str) -> DataFrame:
    """Add the sum of `amount` over the classes earlier in `order`."""
    if n_classes > ORDERED_CLASSES:
        return prefix_sums(sizes, order, amount, output)
    earlier = F.sum(amount).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn(output, F.coalesce(earlier, F.lit(0)))


def stratified_holdout(
    df: DataFrame, label: str, key_columns: list[str], *, fraction: float = 0.2, seed: int = 42
) -> Parts:
    """The test set holds every class in proportion; left-over rows go to the largest fractions."""
    sizes = class_sizes(df, label)
    total = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("classes")).first()
    n_test = math.ceil(total["n"] * holdout_fraction(total["n"], fraction))
    # Whole-number arithmetic keeps the fractions exact.
    share = sizes.withColumn("whole", F.expr(f"n * {n_test}L div {total['n']}L")).withColumn(
        "left", F.expr(f"n * {n_test}L % {total['n']}L"))
    extra = n_test - (share.agg(F.sum("whole")).first()[0] or 0)
    placed = _before(share, total["classes"], [F.desc("left"), F.col("_class")], F.lit(1), "place")
    cuts = placed.select("_class", F.array(F.col("whole") + F.when(F.col("place") < extra, 1).otherwise(0)).alias("cuts"))
    return cut_by_class(df, label, cuts, key_columns, f"{seed}", total["n"], total["classes"])


def stratified_kfold(df: DataFrame, label: str, key_columns: list[str], k: int, *, seed: int = 42) -> Parts:
    """Classes are dealt to the folds in turn, so that fold sizes differ by at most one as well."""
    sizes = class_sizes(df, label)
    total = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("classes")).first()
    # Rows start .. start + n - 1 are dealt; fold i gets those whose position is i modulo k.
    dealt = [F.floor((F.col("start") + F.col("n") + (k - 1 - i)) / k) - F.floor((F.col("start") + (k - 1 - i)) / k)
             for i in range(k)]
    upto = [sum(dealt[1 : i + 1], dealt[0]) for i in range(k - 1)]
    cuts = _before(sizes, total["classes"], [F.col("_class")], F.col("n"), "start").select("_class", F.array(*upto).cast("array<bigint>").alias("cuts"))
    return cut_by_class(df, label, cuts, key_columns, f"{seed}f", total["n"], total["classes"])
