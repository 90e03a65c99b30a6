"""Model comparison: split, cross-validate every candidate, refit the best, score it on held-out rows."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import number_of, ref
from ..functions.staging import HELD_ROWS, held, spread, stage, together
from . import metrics as met
from . import split as sp
from .clean import CleanTable, LogEntry
from .encode import OneHotCoding, OrdinalCoding, PrepModel, fit_labels, fit_prep, label_encode
from .importance import fallback_importance, permutation_importance
from .models import Candidate, FitContext, FittedModel, candidates

PRIMARY = {C.REGRESSION: "r2", C.CLASSIFICATION: "f1_weighted"}
METRICS = {C.REGRESSION: met.REGRESSION_METRICS[:3], C.CLASSIFICATION: met.CLASSIFICATION_METRICS}


#: Put before feature names in modelling rows, so that no input column can be mistaken for one of ours.
FEATURE = "x_"


def shown(name: str) -> str:
    return name.removeprefix(FEATURE)


@dataclass
class PreparedRows:
    """Modelling rows: `_id`, `y`, prefixed features. `labels` holds the class codes of a classification."""

    df: DataFrame
    table: CleanTable
    n_rows: int
    lost_rows: int = 0
    labels: OrdinalCoding | None = None

    @property
    def n_classes(self) -> int:
        return self.labels.n_levels if self.labels else 0


@dataclass
class CandidateScore:
    candidate: Candidate
    ordinal: int
    folds: list[dict[str, float]] = field(default_factory=list)
    seconds: float = 0.0
    error: str = ""

    def mean(self, metric: str) -> float | None:
        """The mean over folds; error measures are reported as positive numbers."""
        values = [f[metric] for f in self.folds if f[metric] is not None]
        return abs(sum(values) / len(values)) if values and metric in ("rmse", "mae") else (
            sum(values) / len(values) if values else None)


@dataclass
class ModelingResult:
    task: str
    target: str
    best_name: str
    model: FittedModel
    prep: PrepModel
    leaderboard: DataFrame
    metrics: DataFrame
    importance: DataFrame
    predictions: DataFrame
    n_train: int
    n_test: int
    labels: DataFrame | None = None
    confusion: DataFrame | None = None
    roc: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    failed: DataFrame | None = None

    @property
    def n_features_out(self) -> int:
        return len(self.prep.feature_names)


def prepare_rows(clean: CleanTable, config: C.AnalysisConfig, task: str) -> PreparedRows:
    """Attach the target as `y` and a fixed row id, and stage the result: every later step reads it."""
    if config.key_columns:
        row_id = sp.row_key(list(config.key_columns))
    else:
        # Generated ids depend on how the input is read: the staged copy freezes them.
        row_id = F.monotonically_increasing_id().cast("string")
    target = F.lit(None).cast("string") if config.target is None else ref(config.target)
    features = [f"{FEATURE}{c}" for c in clean.features]
    df = clean.df.select(
        row_id.alias("_id"), target.alias("_target"), *[ref(c).alias(f) for c, f in zip(clean.features, features)])
    labels = None
    if task == C.CLASSIFICATION:
        if not config.key_columns:
            df = stage(df)
        labels = fit_labels(df, "_target")
        df = label_encode(df, "_target", labels)
    else:
        df = df.withColumn("y", number_of(df, "_target"))
    staged = stage(spread(df.select("_id", "y", *[ref(f) for f in features])))
    if config.key_columns and staged.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"the key columns {', '.join(config.key_columns)} do not identify the rows")
    total = staged.agg(F.count("*").alias("n"), F.count("y").alias("present")).first()
    rows = staged.where(F.col("y").isNotNull())
    if total["n"] > total["present"]:
        clean.log.append(LogEntry("drop rows", config.target, "unreadable target", total["n"] - total["present"]))
    return PreparedRows(rows, clean, total["present"], total["n"] - total["present"], labels)


def split_rows(rows: PreparedRows, config: C.AnalysisConfig, task: str, notes: list[str]) -> tuple[DataFrame, int]:
    """Add `part` (0 test, 1 train) and `fold` (training rows only); gives the number of folds."""
    key, seed = ["_id"], config.random_state
    df = rows.df
    if rows.n_rows < sp.SMALL_SAMPLE:
        notes.append(f"only {rows.n_rows} rows: the metrics have wide confidence intervals")
    stratified = False
    if task == C.CLASSIFICATION:
        smallest = sp.class_sizes(df, "y").agg(F.min("n")).first()[0]
        stratified = smallest is not None and smallest >= 2 and rows.n_classes < rows.n_rows * 0.5
        if not stratified:
            notes.append("some classes are too small for a stratified split")
    if stratified:
        parts = sp.stratified_holdout(df, "y", key, fraction=config.test_size, seed=seed)
    else:
        parts = sp.holdout_split(df, key, rows.n_rows, fraction=config.test_size, seed=seed)
    df = parts.assign(df, "part")

    train = df.where("part = 1")
    n_train = train.count()
    if task == C.CLASSIFICATION:
        smallest = sp.class_sizes(train, "y").agg(F.min("n")).first()[0] or 0
        k = max(2, min(config.cv_folds, smallest))
        folds = sp.stratified_kfold(train, "y", key, k, seed=seed)
    else:
        k = max(2, min(config.cv_folds, n_train))
        folds = sp.kfold(train, key, n_train, k, seed=seed)
    numbered = folds.assign(df, "fold")
    return stage(numbered.withColumn("fold", F.when(F.col("part") == 1, F.col("fold")))), k


def score(task: str, predicted: DataFrame) -> dict[str, float]:
    if task == C.REGRESSION:
        m = met.regression_metrics(predicted)
    else:
        m = met.classification_metrics(met.confusion_counts(predicted))
    return m.first().asDict()


def _try_candidate(s: CandidateScore, fit_rows: DataFrame, check_rows: DataFrame, task: str, context: FitContext) -> None:
    started = time.perf_counter()
    try:
        s.folds.append(score(task, s.candidate.fit(fit_rows, context).predict(check_rows)))
    except Exception as exc:  # a failing candidate must not end the comparison
        s.error = str(exc) or type(exc).__name__
    s.seconds += time.perf_counter() - started


def cross_validate(
    rows: DataFrame, k: int, preps: dict[str, PrepModel], todo: list[Candidate], task: str, context: FitContext,
    sizes: dict[int, int],
) -> list[CandidateScore]:
    """Every candidate on every fold. The prepared fold is built once for all candidates that share it;
    a candidate that fails is recorded and left out from then on."""
    scores = [CandidateScore(c, i) for i, c in enumerate(todo)]
    n_train = sum(sizes.values())
    train = rows.where("part = 1")
    for fold in range(k):
        for scaled in (True, False):
            mine = [s for s in scores if s.candidate.needs_scaling == scaled and not s.error]
            if not mine:
                continue
            prep = preps[f"{fold}"] if scaled else preps[f"{fold}"].unscaled()
            ctx = FitContext(n_train - sizes.get(fold, 0), context.n_classes, context.seed, context.settings)
            with held(prep.transform(train).select("_id", "y", "fold", "features"), n_train) as vectors:
                fit_rows, check_rows = vectors.where(F.col("fold") != fold), vectors.where(F.col("fold") == fold)
                tasks = [partial(_try_candidate, s, fit_rows, check_rows, task, ctx) for s in mine]
                together(rows.sparkSession, tasks, context.settings.parallelism)
    return scores


def leaderboard_table(spark: SparkSession, scores: list[CandidateScore], task: str) -> DataFrame:
    """(rank, model, metrics, seconds), best first; equal scores keep the candidate order."""
    primary = PRIMARY[task]
    done = [s for s in scores if not s.error]
    done.sort(key=lambda s: (-_sortable(s.mean(primary)), s.ordinal))
    names = METRICS[task]
    rows = [(i + 1, s.candidate.name, *[s.mean(m) for m in names], round(s.seconds, 2)) for i, s in enumerate(done)]
    return spark.createDataFrame(
        rows, "rank int, model string, " + ", ".join(f"{m} double" for m in names) + ", seconds double")


def _sortable(value: float | None) -> float:
    return -math.inf if value is None or value != value else value


def leaderboard_display(leaderboard: DataFrame) -> DataFrame:
    return leaderboard.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in leaderboard.dtypes])


def run_comparison(rows: PreparedRows, config: C.AnalysisConfig, task: str) -> ModelingResult:
    """The whole comparison. Raises ValueError without features and RuntimeError when nothing could be fitted."""
    table = rows.table
    if not table.features:
        raise ValueError("no usable feature; check the exclusions")
    if rows.n_rows < 2:
        raise ValueError("not enough rows with a target")
    spark = rows.df.sparkSession
    notes: list[str] = []
    labelled, k = split_rows(rows, config, task, notes)
    train, test = labelled.where("part = 1"), labelled.where("part = 0")
    sizes = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    n_train = sum(sizes.values())
    n_test = rows.n_rows - n_train

    where = {f"{f}": F.col("fold") != f for f in range(k)} | {"all": F.lit(True)}
    preps = fit_prep(
        train, [f"{FEATURE}{c}" for c in table.numeric_features], [f"{FEATURE}{c}" for c in table.categorical_features],
        config, where, frozenset(f"{FEATURE}{c}" for c in table.numeric_levels))
    table.log.extend(preparation_entries(preps["all"], config))
    context = FitContext(n_train, rows.n_classes, config.random_state, config.models)
    scores = cross_validate(labelled, k, preps, candidates(task, config.max_models), task, context, sizes)

    valid = [s for s in scores if not s.error]
    if not valid:
        raise RuntimeError("no candidate could be fitted: " + "; ".join(f"{s.candidate.name}: {s.error}" for s in scores[:3]))
    notes += [f"{s.candidate.name} could not be fitted and was left out" for s in scores if s.error]
    best = min(valid, key=lambda s: (-_sortable(s.mean(PRIMARY[task])), s.ordinal))

    prep = preps["all"] if best.candidate.needs_scaling else preps["all"].unscaled()
    fitted_on = prep.transform(train).select("_id", "y", "features")
    # a model of neighbours reads its rows again later on, so a copy stays
    fitted_on = stage(fitted_on) if n_train > HELD_ROWS else fitted_on.persist(StorageLevel.MEMORY_AND_DISK)
    model = best.candidate.fit(fitted_on, context)
    if n_train <= HELD_ROWS:
        fitted_on.unpersist()
    predicted = model.predict(prep.transform(test).select("_id", "y", "features"))
    predictions = stage(predicted.drop("features"))

    metrics, confusion, roc = holdout_metrics(predictions, train, task, rows.n_classes, notes)
    importance = spark.createDataFrame([], "feature string, importance double, importance_pct double")
    if config.compute_importance:
        try:
            columns = {f"{FEATURE}{c}": c for c in table.features}
            importance = permutation_importance(model, prep, test, columns, task, n_test, config.random_state,
                                                config.importance_repeats)
        except Exception as exc:
            notes.append(f"permutation importance failed, built-in importance is shown instead ({exc})")
            importance = fallback_importance(spark, model, prep, shown)
    failed = spark.createDataFrame(
        [(s.candidate.name, s.error) for s in scores if s.error], "model string, error string")
    return ModelingResult(
        task, config.target or "", best.candidate.name, model, prep, leaderboard_table(spark, scores, task), metrics,
        importance, predictions, n_train, n_test, rows.labels.table if rows.labels else None, confusion, roc, notes, failed,
    )


def preparation_entries(prep: PrepModel, config: C.AnalysisConfig) -> list[LogEntry]:
    onehot = [shown(n) for n, c in prep.categories.items() if isinstance(c, OneHotCoding)]
    ordinal = [shown(n) for n, c in prep.categories.items() if isinstance(c, OrdinalCoding)]
    out = []
    if onehot:
        out.append(LogEntry("encoding", ", ".join(onehot), "one-hot", len(onehot)))
    if ordinal:
        out.append(LogEntry("encoding", ", ".join(ordinal),
                            "ordinal, as there are many levels", len(ordinal)))
    if prep.numbers and config.scaling != "none":
        out.append(LogEntry("scaling", f"{len(prep.numbers)} numeric features", config.scaling, len(prep.numbers)))
    return out


def holdout_metrics(
    predictions: DataFrame, train: DataFrame, task: str, n_classes: int, notes: list[str]
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(metric, value) on the held-out rows, with the confusion cells and ROC points of a classification."""
    spark = predictions.sparkSession
    confusion = roc = None
    values = score(task, predictions)
    if task == C.REGRESSION:
        base = met.regression_metrics(predictions.withColumn("prediction", F.lit(met.mean_baseline(train)))).first()["rmse"]
        values["rmse_gain_pct"] = _improvement(spark, base, values["rmse"], False)
    else:
        confusion = stage(met.confusion_matrix(predictions))
        if n_classes == 2:
            scored = predictions.select(F.col("probability")[1].alias("score"), (F.col("y") == 1).alias("positive"))
            counts = stage(met.score_counts(scored))
            auc = met.auc_of_counts(counts).first()["auc"]
            if auc is None:
                notes.append("the held-out rows hold a single class: no ROC curve")
            else:
                values["roc_auc"], roc = auc, met.curve_of_counts(counts)
        else:
            values["roc_auc_ovr"] = met.auc_ovr(predictions).first()["auc"]
        majority = predictions.withColumn("prediction", F.lit(met.majority_baseline(train)))
        base = met.classification_metrics(met.confusion_counts(majority)).first()["accuracy"]
        values["accuracy_gain_pct"] = _improvement(spark, base, values["accuracy"], True)
    return spark.createDataFrame([Row(metric=k, value=v) for k, v in values.items()], "metric string, value double"), confusion, roc


def _improvement(spark: SparkSession, base: float | None, value: float | None, higher: bool) -> float:
    gap = met.improvement_pct(F.lit(base).cast("double"), F.lit(value).cast("double"), higher_is_better=higher)
    return spark.range(1).select(gap.alias("g")).first()["g"]
