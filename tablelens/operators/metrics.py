"""Model metrics as aggregates over (y, prediction, probability) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .ranking import BUCKET_ROWS, descending_totals

REGRESSION_METRICS = ("r2", "rmse", "mae", "mape_pct")
CLASSIFICATION_METRICS = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted")
#: Targets this close to zero do not enter the percentage error.
ZERO_TARGET = 1e-9


def regression_metrics(rows: DataFrame, by: list[str] | None = None, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """R2, RMSE, MAE and MAPE% in one pass, per group if asked. R2 of a constant target is 1 when it is
    met exactly, else 0."""
    t, p = F.col(y), F.col(prediction)
    err = t - p
    relative = F.when(F.abs(t) >= ZERO_TARGET, F.abs(err / t))
    sums = rows.groupBy(*(by or [])).agg(
        F.sum(err * err).alias("sse"), (F.var_pop(t) * F.count(t)).alias("sst"), F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"), (F.avg(relative) * 100).alias("mape_pct"),
    )
    flat = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("sst") > 0, 1 - F.try_divide("sse", "sst")).when(F.col("sst") == 0, flat)
    return sums.select(*(by or []), r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mape_pct")


def confusion_counts(rows: DataFrame, by: list[str] | None = None, y: str = "y", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(*(by or []), F.col(y).alias("y"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


#: Classes between which empty cells are filled in.
SHOWN_CLASSES = 50


def confusion_matrix(rows: DataFrame, y: str = "y", prediction: str = "prediction", *, shown: int = SHOWN_CLASSES) -> DataFrame:
    """(y, prediction, n): every cell that occurs, and zeros for the empty ones between the `shown` most frequent classes (of
    either side; ties: the least)."""
    counts = confusion_counts(rows, None, y, prediction)
    sides = counts.select(F.explode(F.array(*[F.struct(F.col(c).alias("c"), "n") for c in ("y", "prediction")])).alias("s"))
    frequent = sides.groupBy("s.c").agg(F.sum("s.n").alias("n")).orderBy(F.desc("n"), "c").limit(shown)
    # at most `shown` classes in one row
    grid = frequent.agg(F.collect_list(F.struct("c")).alias("all")).select(F.explode("all.c").alias("y"), "all").select(
        "y", F.explode("all.c").alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(grid).groupBy("y", "prediction").agg(F.sum("n").alias("n"))


def classification_metrics(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted F1, precision and recall from confusion counts; undefined ratios are 0."""
    by = by or []
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("s")).select(*by, "s.*")
    per_class = sides.groupBy(*by, "c").agg(*[F.sum(x).alias(x) for x in ("support", "guessed", "hit")])
    precision = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("guessed")), F.lit(0.0))

    def weighted(x: Column) -> Column:
        return F.try_divide(F.sum(x * F.col("support")), F.sum("support"))

    return per_class.groupBy(*by).agg(
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"), weighted(f1).alias("f1_weighted"),
        weighted(precision).alias("precision_weighted"), weighted(recall).alias("recall_weighted"),
    )


def class_recall(counts: DataFrame) -> DataFrame:
    """(y, support, recall) of every class that occurs."""
    hit = F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.groupBy("y").agg(F.sum("n").alias("support"), hit.alias("hit")).where(F.col("support") > 0).select(
        "y", "support", (F.col("hit") / F.col("support")).alias("recall"))


def improvement_pct(baseline: Column, model: Column, *, higher_is_better: bool) -> Column:
    """How much better than the baseline, in percent of it; 0 when it is 0."""
    gain = (model - baseline) if higher_is_better else (baseline - model)
    return F.coalesce(F.try_divide(gain, F.abs(baseline)) * 100, F.lit(0.0))


# -- ranking metrics -----------------------------------------------------------------------------------
def score_counts(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(score, pos, neg) per distinct score: all ranking metrics need, however many rows share a score."""
    return rows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))


def _won() -> Column:
    """Every negative is beaten by the positives above it and half of those beside it."""
    return F.sum(F.col("neg").cast("double") * (F.col("pos_to") - F.col("pos") / 2))


def roc_auc(rows: DataFrame, score: str = "score", positive: str = "positive", *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row (auc, n_pos, n_neg): exact area, ties counting one half; NULL unless both classes occur."""
    return auc_of_counts(stage(score_counts(rows, score, positive)), bucket_rows=bucket_rows)


def roc_curve(rows: DataFrame, score: str = "score", positive: str = "positive", *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(threshold, fpr, tpr) from the origin (threshold NULL) down; points on a straight line are left out."""
    return curve_of_counts(stage(score_counts(rows, score, positive)), bucket_rows=bucket_rows)


def auc_of_counts(counts: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`roc_auc` from score counts, which are read several times and should be staged."""
    c = descending_totals(counts, "score", ["pos", "neg"], bucket_rows=bucket_rows)
    total = c.agg(_won().alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.select(
        F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def curve_of_counts(counts: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`roc_curve` from score counts."""
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("score").alias("top")).first()
    c = descending_totals(counts, "score", ["pos", "neg"], bucket_rows=bucket_rows)
    end = F.col("pos_next").isNull() | (F.col("score") == F.lit(total["top"]))
    bend = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
    points = c.where(end | bend).select(
        F.col("score").alias("threshold"), F.try_divide(F.col("neg_to"), F.lit(total["n"])).alias("fpr"),
        F.try_divide(F.col("pos_to"), F.lit(total["p"])).alias("tpr"))
    origin = counts.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(points)


def auc_ovr(rows: DataFrame, y: str = "y", probability: str = "probability", *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row (auc): every class against the rest, weighted by its size; `probability` is an array."""
    scored = rows.select(F.col(y).alias("y"), F.posexplode(probability).alias("c", "p"))
    counts = stage(scored.groupBy("c", "p").agg(
        F.count_if(F.col("y") == F.col("c")).alias("pos"), F.count_if(F.col("y") != F.col("c")).alias("neg")))
    cumulated = descending_totals(counts, "p", ["pos", "neg"], group=["c"], bucket_rows=bucket_rows)
    per_class = cumulated.groupBy("c").agg(_won().alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return per_class.agg(F.try_divide(F.sum(auc * F.col("n_pos")), F.sum("n_pos")).alias("auc"))


# -- baselines -----------------------------------------------------------------------------------------
def mean_baseline(train: DataFrame, y: str = "y") -> float | None:
    return train.agg(F.avg(y)).first()[0]


def majority_baseline(train: DataFrame, y: str = "y") -> float | None:
    """The most frequent class, the smallest of equals."""
    counts = train.groupBy(F.col(y).alias("y")).agg(F.count("*").alias("n"))
    row = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), "y"))["y"].alias("y")).first()
    return row["y"]
