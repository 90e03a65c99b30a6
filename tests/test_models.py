"""Models against closed forms, whole comparisons on shaped data, fallbacks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens import AnalysisConfig, ModelSettings, analyze, clean_frame, prepare_rows, profile_table, run_comparison
from tablelens import config as C
from tablelens.operators import compare as cmp
from tablelens.operators import importance as imp
from tablelens.operators import models as mo

LIGHT = ModelSettings(n_trees=5, forest_depth=4, forest_bins=32, boosting_rounds=3, hist_bins=32, max_iter=200, parallelism=4)


def compared(df, task, **options):
    config = AnalysisConfig(models=LIGHT, cv_folds=options.pop("cv_folds", 3), **options)
    clean = clean_frame(df, profile_table(df), config)
    return run_comparison(prepare_rows(clean, config, task), config, task)


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def boxes(spark, n=240):
    """Prices by width and depth, beside an empty, a constant and a key column; some widths are unknown."""
    return spark.range(n).selectExpr(
        "CAST(NULL AS double) AS nothing", "'EUR' AS currency", "concat('BOX-', id) AS box", "elt(1 + id % 4, 'oak', 'ash', 'elm', 'fir') AS wood",
        "CASE WHEN id % 13 <> 5 THEN (id * 37 % 101) / 2D END AS width", "(id * 53 % 17) / 4D AS depth",
        "3 * (id * 37 % 101) / 2D + 4 * (id * 53 % 17) / 4D + (id * 29 % 11) / 5D AS price")


# -- estimators ----------------------------------------------------------------------------------------------
def vector_frame(spark, x, y):
    rows = [(str(i), float(t), v.tolist()) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "_id string, y double, v array<double>").withColumn("features", array_to_vector("v"))


def test_ridge_and_elastic_net_meet_their_objectives(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [2.0, -1.0, 0.0] + 3 + rng.normal(size=80)
    df = vector_frame(spark, x, y)
    context = mo.FitContext(80, 0, 42, LIGHT)
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = mo.regression_candidates()[1].fit(df, context).model
    assert ridge.coefficients.toArray() == pytest.approx(np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc), abs=1e-8)
    net = mo.regression_candidates()[2].fit(df, context).model.coefficients.toArray()
    gradient = -xc.T @ (yc - xc @ net) / 80 + 0.05 * net
    assert all(abs(g + 0.05 * np.sign(w)) < 1e-3 if w else abs(g) <= 0.05 + 1e-3 for g, w in zip(gradient, net))


def test_logistic_regression_meets_its_objective(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = (x @ [1.5, -1] + rng.normal(size=120) > 0).astype(float)
    model = mo.classification_candidates()[0].fit(vector_frame(spark, x, y), mo.FitContext(120, 2, 42, LIGHT)).model
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert x.T @ (p - y) + w == pytest.approx([0, 0], abs=1e-2)


def test_many_class_boosting_gives_probabilities(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    y = np.digitize(x[:, 0], [-0.5, 0.5]).astype(float)
    fitted = mo.classification_candidates()[4].fit(vector_frame(spark, x, y), mo.FitContext(90, 3, 42, LIGHT))
    rows = fitted.predict(vector_frame(spark, x, y)).collect()
    assert all(sum(r["probability"]) == pytest.approx(1) and len(r["probability"]) == 3 for r in rows)
    assert np.mean([r["prediction"] == r["y"] for r in rows]) > 0.8


def test_candidate_lists():
    assert len(mo.candidates(C.REGRESSION, 8)) == 8 and mo.candidates(C.REGRESSION, 9)[-1].name == "k nearest neighbours"
    assert [c.name for c in mo.candidates(C.CLASSIFICATION, 2)] == ["logistic regression", "decision tree"]


# -- comparisons ---------------------------------------------------------------------------------------------
def test_prices_are_explained(spark):
    result = analyze(boxes(spark), AnalysisConfig(target="price", cv_folds=4, max_models=3, models=LIGHT),
                     source_meta={"source": "boxes"})
    assert result.task == "regression" and result.has_model
    m = values(result.modeling.metrics)
    assert m["r2"] > 0.6 and m["rmse_gain_pct"] > 30
    assert result.modeling.importance.first()["feature"] == "width" and (result.modeling.n_train, result.modeling.n_test) == (192, 48)
    assert {"missing", "distribution", "target", "residual", "pred_actual", "group_mean"} <= set(result.charts)
    assert result.findings.where("rule_id = 'summary_target' AND subject = 'price'").count() == 1


def test_few_rows_are_enough_for_a_line(spark):
    df = spark.range(24).selectExpr("id AS step", "100 - 3 * id + id % 2 AS level")
    result = analyze(df, AnalysisConfig(target="level", cv_folds=2, max_models=1, models=LIGHT, column_types={"level": "numeric", "step": "numeric"}))
    assert result.has_model and values(result.modeling.metrics)["r2"] > 0.9


def renewals(spark, n=600):
    """Contracts that are renewed the likelier the more often a shop calls, with a plan and a region that say nothing."""
    rng = np.random.default_rng(19)
    calls, floor_space = rng.poisson(6, n), rng.lognormal(4, 0.5, n)
    kept = rng.random(n) < 1 / (1 + np.exp(5.0 - calls))
    rows = [(10_000 + 3 * i, int(calls[i]) + float(i % 4) / 8, float(floor_space[i]), ["basic", "plus", "max"][i * i % 3], "renewed" if kept[i] else "ended")
            for i in range(n)]
    return spark.createDataFrame(rows, "contract long, calls double, floor_space double, plan string, outcome string")


def test_binary_classification(spark):
    result = compared(renewals(spark), C.CLASSIFICATION, target="outcome", key_columns=("contract",), max_models=7)
    m = values(result.metrics)
    assert m["accuracy"] > 0.75 and m["roc_auc"] > 0.8
    assert [r["level"] for r in result.labels.orderBy("code").collect()] == ["ended", "renewed"]
    assert result.confusion.count() == 4 and result.roc.count() >= 3
    board = result.leaderboard.orderBy("rank").collect()
    assert [r["rank"] for r in board] == list(range(1, 8)) and board[0]["model"] == result.best_name
    assert result.importance.first()["feature"] == "calls" and result.failed.count() == 0


def test_same_result_for_any_partitioning(spark):
    df = renewals(spark, 300)
    boards = [compared(df.repartition(n), C.CLASSIFICATION, target="outcome", key_columns=("contract",), max_models=1,
                       compute_importance=False, cv_folds=2) for n in (1, 9)]
    a, b = (sorted((r["_id"], r["y"], r["prediction"]) for r in x.predictions.collect()) for x in boards)
    assert a == b


def test_failing_candidates_are_recorded(spark, monkeypatch):
    def broken(train, context):
        raise ValueError("no luck")

    good = mo.regression_candidates()[0]
    monkeypatch.setattr(cmp, "candidates", lambda task, limit: [mo.Candidate("broken", True, broken), good])
    result = compared(boxes(spark), C.REGRESSION, target="price")
    assert result.best_name == good.name and result.failed.first()["error"] == "no luck"
    assert any("broken" in n for n in result.notes)
    monkeypatch.setattr(cmp, "candidates", lambda task, limit: [mo.Candidate("broken", True, broken)])
    fallback = analyze(boxes(spark), AnalysisConfig(target="price", models=LIGHT))
    assert fallback.task == "eda" and not fallback.has_model and any("no luck" in m for m in fallback.messages)


def test_small_classes_prevent_stratification(spark):
    rows = [(float(i % 7), "a" if i < 30 else "b" if i < 59 else "lone") for i in range(60)]
    result = compared(spark.createDataFrame(rows, "x double, y string"), C.CLASSIFICATION, target="y", max_models=1,
                      cv_folds=2, column_types={"x": "numeric"})
    assert any("stratified" in n for n in result.notes) and result.n_test == 12


def test_names_of_ours_may_be_columns(spark):
    rows = [(float(i % 29), f"c{i % 3}", float(i % 31), float(i % 5 + i % 29), "2024-01-05" if i % 2 else "2024-03-07", i % 29 > 12)
            for i in range(120)]
    df = spark.createDataFrame(rows, "features double, _id string, fold double, y_year double, y string, prediction boolean")
    result = analyze(df, AnalysisConfig(target="prediction", cv_folds=2, max_models=2, models=LIGHT))
    assert result.has_model, result.messages
    assert {"features", "_id", "fold", "y_year", "y_year_"} <= set(result.clean.features)
    assert result.modeling.importance.first()["feature"] in ("features", "y_year")


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([(i // 2, float(i), float(i % 40)) for i in range(100)], "k int, x double, y double")
    result = analyze(df, AnalysisConfig(target="y", key_columns=("k",), models=LIGHT))
    assert not result.has_model and any("do not identify" in m for m in result.messages)


def test_unusable_inputs_fall_back(spark):
    df = spark.createDataFrame([("same", float(i)) for i in range(40)], "c string, y double")
    r = analyze(df, AnalysisConfig(target="y", models=LIGHT))
    assert r.task == "eda" and any("no usable feature" in m for m in r.messages)
    assert analyze(df, AnalysisConfig(target="absent")).task == "eda"


# -- importance ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n, repeats", [(1, 3), (2, 10), (7, 10), (60, 5)])
def test_every_row_gives_once_whatever_the_buckets(spark, n, repeats, monkeypatch):
    df = spark.range(n).select(F.col("id").cast("string").alias("_id"), F.lit(0.0).alias("y"), F.array(F.col("id").cast("double")).alias("f"))
    seen = []
    for rows_in_bucket in (50_000, 4):
        monkeypatch.setattr(imp, "BUCKET_ROWS", rows_in_bucket)
        rows = imp.exchanged(imp.with_places(df, n, 42), [0], 1, n, repeats).collect()
        seen.append(sorted((r["_id"], r["f"][0]) for r in rows))
        for rep in range(repeats):
            own = [r for r in rows if r["_rep"] == rep]
            assert sorted(r["f"][0] for r in own) == list(range(n))
            assert n == 1 or all(r["_id"].split("|")[0] != str(int(r["f"][0])) for r in own)
    assert seen[0] == seen[1]


def test_exchange_changes_the_slots_of_one_column(spark):
    df = spark.createDataFrame([(str(i), 0.0, i, [float(i), 100.0 + i, 200.0 + i]) for i in range(20)], "_id string, y double, _place long, f array<double>")
    rows = imp.exchanged(df, [0, 1, 1], 2, 20, 2).collect()
    assert len(rows) == 80 and len({r["_id"] for r in rows}) == 80
    for r in rows:
        i = float(r["_id"].split("|")[0])
        same = [r["f"][0] == i, r["f"][1] == 100 + i, r["f"][2] == 200 + i]
        assert same == ([False, True, True] if r["_col"] == 0 else [True, False, False])
