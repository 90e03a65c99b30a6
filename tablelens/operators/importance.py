"""Permutation importance of the input columns, and the model's own importances as a fallback."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.staging import stage
from . import metrics as met
from .encode import PrepModel
from .models import FittedModel
from .split import row_hash

#: Rows that one task puts in order; only the plan depends on it.
BUCKET_ROWS = 50_000
IMPORTANCE = "feature string, importance double, importance_pct double"


def with_places(rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Add `_place`: the position of each row in the order of a hash of `_id`, from 0. Rows are numbered within leading
    digits of the hash, and the digits' sizes added up."""
    digits = max(0, math.ceil(math.log(max(1, n_rows / BUCKET_ROWS), 16)))
    keyed = rows.withColumn("_h", row_hash(F.col("_id"), f"{seed}p")).withColumn("_bucket", F.substring("_h", 1, digits))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row per bucket
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "_id"))
    numbered = keyed.withColumn("_own", own).join(offsets, "_bucket")
    return numbered.withColumn("_place", F.col("_before") + F.col("_own") - 1).drop("_h", "_bucket", "_own", "_before")


def exchanged(encoded: DataFrame, owners: list[int], n_columns: int, n_rows: int, repeats: int) -> DataFrame:
    """Every row once per repeat and column, with the slots of that one column taken from another row; `_col` and `_rep`
    say which. encoded: (_id, y, _place, f), owners: the column of each slot of f. In repeat r a row takes from the row r
    places on, around the end of all rows, so every row gives exactly once in each repeat."""
    step = F.col("_rep") % max(n_rows - 1, 1) + 1
    asking = encoded.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_rep")).withColumn(
        "_from", (F.col("_place") + step) % n_rows)
    giving = encoded.select(F.col("_place").alias("_from"), F.col("f").alias("g"))
    each = asking.join(giving, "_from").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_columns - 1))).alias("_col"))
    owner = F.array(*[F.lit(o) for o in owners])
    swapped = F.transform("f", lambda x, i: F.when(F.get(owner, i) == F.col("_col"), F.get("g", i)).otherwise(x))
    return each.select(F.concat_ws("|", "_id", "_rep", "_col").alias("_id"), "y", "_rep", "_col", swapped.alias("f"))


def permutation_importance(
    model: FittedModel, prep: PrepModel, test: DataFrame, columns: dict[str, str], task: str, n_test: int, seed: int,
    repeats: int = 5,
) -> DataFrame:
    """(feature, importance, importance_pct): mean loss of R2 or weighted F1 when one input column is
    shuffled, not below 0, largest first. `columns` gives the name to show for each column. Rows are encoded once, and
    only the encoded slots of a column change places; all columns and repeats are scored in one job."""
    keys, names = ["_rep", "_col"], list(columns)
    owners = [names.index(s) if s in columns else -1 for s in prep.feature_sources]
    encoded = prep.transform(test).select("_id", "y", vector_to_array("features").alias("f"))
    encoded = stage(with_places(encoded, n_test, seed))
    rows = exchanged(encoded, owners, len(names), n_test, repeats)
    predicted = model.predict(rows.select("_id", "y", *keys, array_to_vector("f").alias("features")))
    plain = model.predict(encoded.select("_id", "y", array_to_vector("f").alias("features")))
    if task == C.REGRESSION:
        scores = met.regression_metrics(predicted, keys).select("_col", F.col("r2").alias("s"))
        base = met.regression_metrics(plain).first()["r2"]
    else:
        scores = met.classification_metrics(met.confusion_counts(predicted, keys), keys).select(
            "_col", F.col("f1_weighted").alias("s"))
        base = met.classification_metrics(met.confusion_counts(plain)).first()["f1_weighted"]
    drops = {r["_col"]: r["s"] for r in scores.groupBy("_col").agg(F.avg("s").alias("s")).collect()}
    losses = [(c, max(0.0, base - drops[i]) if drops.get(i) is not None else 0.0) for i, c in enumerate(columns.values())]
    return importance_table(test.sparkSession, losses)


def importance_table(spark: SparkSession, values: list[tuple[str, float]]) -> DataFrame:
    """Rounded values with their share in percent, largest first, then in column order."""
    total = sum(v for _, v in values)
    ranked = sorted(values, key=lambda x: -x[1])
    rows = [(n, round(v, 6), round(v / total * 100, 2) if total > 0 else 0.0) for n, v in ranked]
    return spark.createDataFrame(rows, IMPORTANCE)


def fallback_importance(
    spark: SparkSession, model: FittedModel, prep: PrepModel, shown: Callable[[str], str] = str
) -> DataFrame:
    """The model's own importances, added up per input column; empty when it has none."""
    values = model.importances()
    if values is None or len(values) != len(prep.feature_sources):
        return spark.createDataFrame([], IMPORTANCE)
    per_source: dict[str, float] = {}
    for source, v in zip(prep.feature_sources, values):
        per_source[shown(source)] = per_source.get(shown(source), 0.0) + v
    return importance_table(spark, list(per_source.items()))
