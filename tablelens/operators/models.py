"""The candidate models behind one small interface: MLlib estimators, trees grown by sums of our own, exact nearest neighbours.

A training frame has the columns `_id`, `y` and `features`; a prediction frame gains `prediction` and,
for classes, an array `probability`."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import classification as cls
from pyspark.ml import regression as reg
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import boosting, extra_trees, knn


@dataclass(frozen=True)
class FitContext:
    """What a candidate may want to know about the training rows."""

    n_rows: int
    n_classes: int
    seed: int
    settings: C.ModelSettings


class FittedModel(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...

    def importances(self) -> list[float] | None: ...


Fit = Callable[[DataFrame, FitContext], FittedModel]


@dataclass(frozen=True)
class Candidate:
    name: str
    needs_scaling: bool
    fit: Fit


class MLlibModel:
    """A fitted MLlib model; probabilities come out as arrays."""

    def __init__(self, model, is_classifier: bool):
        self.model, self.is_classifier = model, is_classifier

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if not self.is_classifier:
            return out.select(*df.columns, "prediction")
        return out.select(*df.columns, "prediction", vector_to_array("probability").alias("probability"))

    def importances(self) -> list[float] | None:
        """Tree importances, or the mean absolute coefficient, per encoded feature."""
        m = self.model
        if hasattr(m, "featureImportances"):
            return [float(v) for v in m.featureImportances.toArray()]
        if hasattr(m, "coefficientMatrix"):
            return [float(v) for v in abs(m.coefficientMatrix.toArray()).mean(axis=0)]
        if hasattr(m, "coefficients"):
            return [float(abs(v)) for v in m.coefficients.toArray()]
        return None


class NeighbourModel:
    """Nearest neighbours keep the training rows; predicting is a join."""

    def __init__(self, train: DataFrame, k: int, n_classes: int):
        self.train = train.select(F.col("_id").alias("tid"), vector_to_array("features").alias("v"), "y")
        self.k, self.n_classes = k, n_classes

    def predict(self, df: DataFrame) -> DataFrame:
        queries = df.select(F.col("_id").alias("qid"), vector_to_array("features").alias("v"))
        found = knn.nearest(queries, self.train, self.k)
        result = knn.vote_of_neighbours(found, self.n_classes) if self.n_classes else knn.mean_of_neighbours(found)
        return df.join(result.withColumnRenamed("qid", "_id"), "_id").select(*df.columns, *result.columns[1:])

    def importances(self) -> list[float] | None:
        return None


def _regressor(make: Callable[[FitContext], object]) -> Fit:
    return lambda train, ctx: MLlibModel(make(ctx).setLabelCol("y").fit(train), False)


def _penalised(l1: Callable[[FitContext], float], l2: Callable[[FitContext], float]) -> Fit:
    """Linear regression minimising half the mean squared error + l1 |w| + l2 / 2 w^2.

    MLlib standardises the target, which divides its squared penalty by the target's deviation."""

    def fit(train: DataFrame, ctx: FitContext) -> FittedModel:
        deviation = train.agg(F.stddev_pop("y")).first()[0] or 1.0
        absolute, squared = l1(ctx), l2(ctx) * deviation
        est = reg.LinearRegression(regParam=absolute + squared, elasticNetParam=absolute / (absolute + squared),
                                   maxIter=ctx.settings.max_iter, tol=1e-9, standardization=False)
        return MLlibModel(est.setLabelCol("y").fit(train), False)

    return fit


def _classifier(make: Callable[[FitContext], object]) -> Fit:
    def fit(train: DataFrame, ctx: FitContext) -> FittedModel:
        # Naming the number of classes keeps the class axis whole when a fold lacks one.
        meta = {"ml_attr": {"type": "nominal", "num_vals": ctx.n_classes}}
        rows = train.withColumn("y", F.col("y").alias("y", metadata=meta))
        return MLlibModel(make(ctx).setLabelCol("y").fit(rows), True)

    return fit


def _neighbours(train: DataFrame, ctx: FitContext) -> FittedModel:
    return NeighbourModel(train, ctx.settings.neighbours, ctx.n_classes)


def _extra_trees(train: DataFrame, ctx: FitContext) -> FittedModel:
    """All features are tried for a regression, their square root for classes; every tree has all rows."""
    s = ctx.settings
    n_tried = None
    if ctx.n_classes:
        n_features = train.agg(F.max(F.size(vector_to_array("features")))).first()[0] or 1
        n_tried = max(1, math.isqrt(n_features))
    return extra_trees.fit(train, n_trees=s.n_trees, max_depth=s.forest_depth, n_tried=n_tried, n_classes=ctx.n_classes, seed=ctx.seed)


def _linear(ctx: FitContext):
    return reg.LinearRegression(solver="auto", standardization=False)


def _logistic(ctx: FitContext):
    return cls.LogisticRegression(
        regParam=1.0 / ctx.n_rows, elasticNetParam=0.0, maxIter=ctx.settings.max_iter, standardization=False)


def _tree(kind) -> Callable[[FitContext], object]:
    return lambda ctx: kind(maxDepth=ctx.settings.tree_depth, maxBins=ctx.settings.tree_bins, seed=ctx.seed)


def _forest(kind, subset: str, bootstrap: bool) -> Callable[[FitContext], object]:
    def make(ctx: FitContext):
        s = ctx.settings
        return kind(numTrees=s.n_trees, maxDepth=s.forest_depth, maxBins=s.forest_bins, seed=ctx.seed,
                    featureSubsetStrategy=subset, bootstrap=bootstrap)

    return make


def _gradient_boosting(train: DataFrame, ctx: FitContext) -> FittedModel:
    """MLlib's boosting of a number or of two classes; of more classes, a tree per class and round against the softmax."""
    s = ctx.settings
    if ctx.n_classes > 2:
        few = boosting.Settings(s.boosting_rounds, s.boosting_step, s.boosting_depth, 2 ** s.boosting_depth, s.forest_bins, least_rows=1)
        return boosting.fit(train, few, n_classes=ctx.n_classes)
    kind = cls.GBTClassifier if ctx.n_classes else reg.GBTRegressor
    make = _classifier if ctx.n_classes else _regressor
    return make(lambda c: kind(maxIter=s.boosting_rounds, stepSize=s.boosting_step, seed=c.seed, maxDepth=s.boosting_depth, maxBins=s.forest_bins))(train, ctx)


def _histogram_boosting(train: DataFrame, ctx: FitContext) -> FittedModel:
    s = ctx.settings
    return boosting.fit(train, boosting.Settings(s.boosting_rounds, s.boosting_step, s.hist_depth, bins=s.hist_bins), n_classes=ctx.n_classes)


def regression_candidates() -> list[Candidate]:
    """In the order they are tried; ties go to the earlier one."""
    # Ridge: penalty 1 on the sum of squares, i.e. 1 / n on their mean. Elastic net: 0.1, half of it absolute.
    return [
        Candidate("linear regression", True, _regressor(_linear)),
        Candidate("ridge regression", True, _penalised(lambda c: 0.0, lambda c: 1.0 / c.n_rows)),
        Candidate("elastic net", True, _penalised(lambda c: 0.05, lambda c: 0.05)),
        Candidate("decision tree", False, _regressor(_tree(reg.DecisionTreeRegressor))),
        Candidate("random forest", False, _regressor(_forest(reg.RandomForestRegressor, "all", True))),
        Candidate("extra trees", False, _extra_trees),
        Candidate("gradient boosting", False, _gradient_boosting),
        Candidate("histogram boosting", False, _histogram_boosting),
        Candidate("k nearest neighbours", True, _neighbours),
    ]


def classification_candidates() -> list[Candidate]:
    return [
        Candidate("logistic regression", True, _classifier(_logistic)),
        Candidate("decision tree", False, _classifier(_tree(cls.DecisionTreeClassifier))),
        Candidate("random forest", False, _classifier(_forest(cls.RandomForestClassifier, "sqrt", True))),
        Candidate("extra trees", False, _extra_trees),
        Candidate("gradient boosting", False, _gradient_boosting),
        Candidate("histogram boosting", False, _histogram_boosting),
        Candidate("k nearest neighbours", True, _neighbours),
    ]


def candidates(task: str, limit: int) -> list[Candidate]:
    return (regression_candidates() if task == C.REGRESSION else classification_candidates())[:limit]
