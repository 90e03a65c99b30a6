"""The data behind every chart, as small DataFrames. Nothing is drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import number_of, ref
from ..functions.text import shorten
from .correlation import correlation_heatmap
from .profile import TableProfile

MIN_BINS, MAX_BINS = 10, 40
DEFAULTS = C.AnalysisConfig()
HISTOGRAM = "name string, bin int, low double, high double, n bigint, median double"


# -- exploring -----------------------------------------------------------------------------------------
def missing_chart(profile: DataFrame, top_n: int = 20) -> DataFrame:
    """Columns with gaps, the emptiest first."""
    return (
        profile.where(F.col("n_missing") > 0).orderBy(F.desc("missing_ratio"), "ordinal").limit(top_n)
        .select("name", shorten(F.col("name")).alias("label"), (F.col("missing_ratio") * 100).alias("missing_pct"))
    )


def n_bins(n: int) -> int:
    return min(MAX_BINS, max(MIN_BINS, int(math.sqrt(n))))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of x from 0; the last bin includes its upper edge. The quotient is put right
    against the edges, which decide."""
    step = (high - low) / bins
    last = F.lit(bins - 1)
    guess = F.greatest(F.lit(0), F.least(F.floor((x - F.lit(low)) / F.lit(step)), last))
    down = F.when(x < F.lit(low) + guess * F.lit(step), guess - 1).otherwise(guess)
    up = F.when((x >= F.lit(low) + (guess + 1) * F.lit(step)) & (guess < last), guess + 1).otherwise(down)
    return F.when(x.isNotNull(), F.greatest(F.lit(0), up)).cast("int")


def histograms(df: DataFrame, columns: dict[str, tuple[Column, float, float, int, float | None]]) -> DataFrame:
    """(name, bin, low, high, n, median) of several columns in one pass, empty bins included.
    `columns` gives expression, minimum, maximum, number of values and median."""
    spark = df.sparkSession
    spine, cells = [], []
    for k, (name, (x, low, high, n, median)) in enumerate(columns.items()):
        if low == high:
            low, high = low - 0.5, high + 0.5
        bins = n_bins(n)
        step = (high - low) / bins
        cells.append(bin_of(x, low, high, bins).alias(str(k)))
        spine += [(k, b, name, low + b * step, high if b == bins - 1 else low + (b + 1) * step, median) for b in range(bins)]
    if not cells:
        return spark.createDataFrame([], HISTOGRAM)
    numbered = df.select(*cells)
    counts = (
        numbered.unpivot([], list(numbered.columns), "k", "bin").where(F.col("bin").isNotNull())
        .groupBy(F.col("k").cast("int").alias("k"), "bin").agg(F.count("*").alias("n"))
    )
    frame = spark.createDataFrame(spine, "k int, bin int, name string, low double, high double, median double")
    # Both sides hold at most MAX_BINS rows per column.
    return frame.join(F.broadcast(counts), ["k", "bin"], "left").select(
        "name", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "median")


def numeric_histograms(df: DataFrame, profile: TableProfile, max_cols: int = DEFAULTS.histogram_columns) -> DataFrame:
    wanted = {}
    for name in profile.names_by_type(C.NUMERIC)[:max_cols]:
        c = profile[name]
        if c.minimum is not None and math.isfinite(c.minimum) and math.isfinite(c.maximum):
            wanted[name] = (number_of(df, name), c.minimum, c.maximum, profile.n_rows - c.n_missing, c.median)
    return histograms(df, wanted)


def histogram_of(df: DataFrame, name: str, x: Column) -> DataFrame:
    """The histogram of one expression."""
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not row["n"]:
        return df.sparkSession.createDataFrame([], HISTOGRAM).drop("median")
    return histograms(df, {name: (x, float(row["lo"]), float(row["hi"]), row["n"], None)}).drop("median")


def class_distribution(df: DataFrame, target: str, top_n: int = DEFAULTS.shown_classes) -> DataFrame:
    """The most frequent classes with their share among those shown, the ratio of the largest to the
    smallest shown, and how many rows have no class."""
    counts = df.groupBy(ref(target).cast("string").alias("label")).agg(F.count("*").alias("n")).persist()
    missing = counts.where(F.col("label").isNull()).select("n").first()
    top = counts.where(F.col("label").isNotNull()).orderBy(F.desc("n"), "label").limit(top_n).collect()
    counts.unpersist()
    total = sum(r["n"] for r in top)
    ratio = top[0]["n"] / max(top[-1]["n"], 1) if top else None
    rows = [(i + 1, r["label"], r["n"], r["n"] / total, ratio, missing["n"] if missing else 0) for i, r in enumerate(top)]
    return df.sparkSession.createDataFrame(
        rows, "rank int, label string, n bigint, share double, max_min_ratio double, n_missing bigint")


def target_distribution(df: DataFrame, target: str, task: str, top_n: int = DEFAULTS.shown_classes) -> DataFrame:
    return histogram_of(df, target, number_of(df, target)) if task == C.REGRESSION else class_distribution(df, target, top_n)


def box_stats(df: DataFrame, profile: TableProfile, max_cols: int = DEFAULTS.box_columns) -> DataFrame:
    """Box plot numbers of the standardised columns: quartiles, whiskers on the last value inside the
    fences, and the points beyond. Constant columns are skipped; fewer than two give no rows."""
    schema = ("ordinal int, name string, q1 double, median double, q3 double, low_whisker double, "
              "high_whisker double, n_beyond bigint")
    spark = df.sparkSession
    shown = [profile[n] for n in profile.names_by_type(C.NUMERIC)[:max_cols]]
    shown = [c for c in shown if c.std and math.isfinite(c.std)]
    if len(shown) < 2:
        return spark.createDataFrame([], schema)
    aggs = []
    for k, c in enumerate(shown):
        x = number_of(df, c.name)
        inside = F.when(x.between(F.lit(c.low_bound), F.lit(c.high_bound)), x)
        aggs += [F.min(inside).alias(f"{k}|lo"), F.max(inside).alias(f"{k}|hi"), F.count(x).alias(f"{k}|n"),
                 F.count_if(x.isNotNull() & inside.isNull()).alias(f"{k}|out")]
    row = df.agg(*aggs).first()
    rows = []
    for k, c in enumerate(shown):
        n = row[f"{k}|n"]
        spread = c.std * math.sqrt((n - 1) / n)
        low, high = row[f"{k}|lo"], row[f"{k}|hi"]
        low = c.q1 if low is None or low > c.q1 else low
        high = c.q3 if high is None or high < c.q3 else high
        z = [(v - c.mean) / spread for v in (c.q1, c.median, c.q3, low, high)]
        rows.append((c.ordinal, c.name, *z, row[f"{k}|out"]))
    return spark.createDataFrame(rows, schema)


def target_by_category(
    df: DataFrame, target: str, categories: list[str], *, max_charts: int = DEFAULTS.group_charts,
    max_groups: int = DEFAULTS.group_rows,
) -> DataFrame:
    """(chart, name, label, mean, overall): mean target of the leading groups of the first categories.
    Empty unless four fifths of the target are numbers; a category with one group is left out."""
    schema = "chart int, name string, label string, mean double, overall double"
    spark = df.sparkSession
    t = number_of(df, target)
    total = df.agg(F.avg(t).alias("mean"), F.count(t).alias("n"), F.count("*").alias("rows")).first()
    rows = []
    if total["rows"] and total["n"] / total["rows"] >= 0.8:
        for i, name in enumerate(categories[:max_charts]):
            top = (
                df.where(ref(name).isNotNull()).groupBy(ref(name).cast("string").alias("label")).agg(F.avg(t).alias("mean"))
                .where(F.col("mean").isNotNull()).orderBy(F.desc("mean"), "label").limit(max_groups).collect()
            )
            if len(top) >= 2:
                rows += [(i, name, r["label"], r["mean"], total["mean"]) for r in top]
    return spark.createDataFrame(rows, schema)


# -- modelling -----------------------------------------------------------------------------------------
def model_comparison(leaderboard: DataFrame, metric: str) -> DataFrame:
    """(model, value, best), worst first."""
    return leaderboard.select(
        shorten(F.col("model"), 18).alias("model"), F.col(metric).alias("value"), (F.col("rank") == 1).alias("best"), "rank"
    ).orderBy(F.desc("rank")).drop("rank")


def importance_chart(importance: DataFrame, top_n: int = 15) -> DataFrame:
    """Features that matter, with the number of those that do not."""
    zero = importance.where(F.col("importance") <= 0).count()
    return (
        importance.where(F.col("importance") > 0).orderBy(F.desc("importance"), "feature").limit(top_n)
        .select("feature", shorten(F.col("feature"), 24).alias("label"), "importance", "importance_pct",
                F.lit(zero).cast("bigint").alias("n_zero"))
    )


def confusion_chart(confusion: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion cells with the names of the classes (one row per class pair)."""
    names = labels.select(F.col("code").cast("double").alias("code"), "level")
    actual = names.select(F.col("code").alias("y"), F.col("level").alias("actual"))
    guessed = names.select(F.col("code").alias("prediction"), F.col("level").alias("predicted"))
    return confusion.join(actual, "y").join(guessed, "prediction").select("actual", "predicted", "n")


def roc_chart(roc: DataFrame, auc: float) -> DataFrame:
    return roc.withColumn("auc", F.lit(auc))


def actual_vs_predicted(predictions: DataFrame) -> DataFrame:
    """Every held-out point."""
    return predictions.select(F.col("y").alias("actual"), F.col("prediction").alias("predicted"))


def actual_vs_predicted_grid(predictions: DataFrame, bins: int = MAX_BINS) -> DataFrame:
    """The same points counted on a square grid over the range of the line of perfect prediction."""
    low, high = identity_range(predictions)
    if low is None:
        return predictions.sparkSession.createDataFrame([], "actual_bin int, predicted_bin int, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    cell = [bin_of(F.col(c), low, high, bins).alias(f"{n}_bin") for c, n in (("y", "actual"), ("prediction", "predicted"))]
    return predictions.select(*cell).groupBy("actual_bin", "predicted_bin").agg(F.count("*").alias("n"))


def identity_range(predictions: DataFrame) -> tuple[float | None, float | None]:
    row = predictions.agg(
        F.least(F.min("y"), F.min("prediction")).alias("lo"), F.greatest(F.max("y"), F.max("prediction")).alias("hi")).first()
    return row["lo"], row["hi"]


def residual_histogram(predictions: DataFrame) -> DataFrame:
    return histogram_of(predictions, "residual", F.col("y") - F.col("prediction"))


def left_out(profile: TableProfile, target: str | None, task: str, limits: C.AnalysisConfig) -> list[str]:
    """What the limits keep from being shown, as messages."""
    numeric, categorical = profile.names_by_type(C.NUMERIC), profile.names_by_type(C.CATEGORICAL)
    limited = [("histograms", numeric, limits.histogram_columns), ("boxes", numeric, limits.box_columns),
               ("categorical", categorical, limits.categorical_rows)]
    known = {c.name: c for c in profile.columns}
    out = []
    if target and task == C.REGRESSION:
        limited.append(("means by group", categorical, limits.group_charts))
        for name in categorical[:limits.group_charts]:
            if (known[name].n_unique or 0) > limits.group_rows:
                out.append(f"means by group: the {limits.group_rows} largest of {known[name].n_unique:,} groups of '{name}' are shown")
    elif target in known and task == C.CLASSIFICATION and (known[target].n_unique or 0) > limits.shown_classes:
        out.append(f"target: the {limits.shown_classes} most frequent of {known[target].n_unique:,} classes are shown")
    return [f"{table}: not shown, beyond the first {limit} columns: {', '.join(names[limit:])}" for table, names, limit in limited if names[limit:]] + out


# -- choosing ------------------------------------------------------------------------------------------
def chart_tables(
    df: DataFrame, profile: TableProfile, *, target: str | None = None, task: str = C.EDA, modeling=None,
    top_features: int = 15, limits: C.AnalysisConfig = DEFAULTS,
) -> dict[str, DataFrame]:
    """The chart data that suits the task, by chart key. Keys of empty charts are left out. `limits` says how much each shows."""
    out: dict[str, DataFrame] = {}
    if any(c.n_missing for c in profile.columns):
        out["missing"] = missing_chart(profile.frame())
    if profile.names_by_type(C.NUMERIC):
        out["distribution"] = numeric_histograms(df, profile, limits.histogram_columns)
    if len(profile.names_by_type(C.NUMERIC)) >= 2:
        out["boxplot"] = box_stats(df, profile, limits.box_columns)
        out["correlation"] = correlation_heatmap(profile.correlation())
    if target and target in df.columns:
        out["target"] = target_distribution(df, target, task, limits.shown_classes)
        if task == C.REGRESSION:
            out["group_mean"] = target_by_category(
                df, target, profile.names_by_type(C.CATEGORICAL), max_charts=limits.group_charts, max_groups=limits.group_rows)
    if modeling is not None:
        metric = "r2" if modeling.task == C.REGRESSION else "f1_weighted"
        out["model_comparison"] = model_comparison(modeling.leaderboard, metric)
        out["importance"] = importance_chart(modeling.importance, top_features)
        if modeling.task == C.REGRESSION:
            out["pred_actual"] = actual_vs_predicted(modeling.predictions)
            out["residual"] = residual_histogram(modeling.predictions)
        else:
            out["confusion"] = confusion_chart(modeling.confusion, modeling.labels)
            if modeling.roc is not None:
                auc = modeling.metrics.where("metric = 'roc_auc'").first()["value"]
                out["roc"] = roc_chart(modeling.roc, auc)
    return out
