"""Cleaning, encoding and scaling: fit on some rows, apply to others."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablelens import AnalysisConfig, TablePrep, clean_frame, fit_prep, profile_table
from tablelens.operators import encode as enc
from tablelens.operators import ranking


def vectors(df, prep, key="i"):
    rows = prep.transform(df).select(key, vector_to_array("features").alias("v")).orderBy(key).collect()
    return [list(r["v"]) for r in rows]


def test_rare_and_unknown_levels(spark):
    train = spark.createDataFrame([(i, "a" if i < 120 else "b" if i < 199 else "rare") for i in range(200)], "i int, c string")
    prep = fit_prep(train, [], ["c"], AnalysisConfig())["all"]
    assert prep.feature_names == ["c=a", "c=b", "c=(rare)"]
    new = spark.createDataFrame([(0, "a"), (1, "b"), (2, "rare"), (3, "unseen"), (4, None)], "i int, c string")
    assert vectors(new, prep) == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1], [1, 0, 0]]
    plain = fit_prep(train.where("c <> 'rare'"), [], ["c"], AnalysisConfig())["all"]
    assert plain.feature_names == ["c=a", "c=b"]
    assert vectors(new, plain)[3] == [0, 0]


def test_constant_fill_is_a_level(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, None)], "i int, c string")
    prep = fit_prep(df, [], ["c"], AnalysisConfig(categorical_impute="constant"))["all"]
    assert prep.feature_names == ["c=a", "c=b", "c=미상"]
    assert vectors(df, prep)[1] == [0, 0, 1]


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "i int, c string")
    assert fit_prep(df, [], ["c"], AnalysisConfig())["all"].categories["c"].fill == "a"


@pytest.mark.parametrize("levels, kind", [(30, enc.OneHotCoding), (31, enc.OrdinalCoding)])
def test_routing_by_number_of_levels(spark, levels, kind):
    df = spark.createDataFrame([(i, f"v{i % levels:02d}") for i in range(levels * 3)], "i int, c string")
    assert isinstance(fit_prep(df, [], ["c"], AnalysisConfig())["all"].categories["c"], kind)


@pytest.mark.parametrize("many", [False, True])
def test_ordinal_codes(spark, many, monkeypatch):
    if many:  # the shuffled path, with hot levels and several ranges
        monkeypatch.setattr(enc, "BROADCAST_LEVELS", 5)
        monkeypatch.setattr(enc, "BROADCAST_BYTES", 5)
        monkeypatch.setattr(enc, "HOT_SHARE", 0.2)
        sorted_codes = ranking.sorted_codes
        monkeypatch.setattr(enc, "sorted_codes", lambda *a, **k: sorted_codes(*a, **k, bucket_rows=7))
    values = [f"v{i % 97:03d}" for i in range(200)] + ["v050"] * 100
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    prep = fit_prep(df, [], ["c"], AnalysisConfig())["all"]
    assert bool(prep.categories["c"].hot) == many
    new = spark.createDataFrame([(0, "v000"), (1, "v096"), (2, "v050"), (3, "zzz"), (4, None)], "i int, c string")
    assert vectors(new, prep) == [[0], [96], [50], [-1], [50]]


def test_numeric_levels_sort_as_numbers(spark):
    df = spark.createDataFrame([(i, str(i % 40)) for i in range(80)], "i int, c string")
    prep = fit_prep(df, [], ["c"], AnalysisConfig(), numeric_levels=frozenset(["c"]))["all"]
    assert vectors(df, prep)[:12] == [[float(i)] for i in range(12)]


@pytest.mark.parametrize("impute, scaling", [(i, s) for i in ("median", "mean", "constant") for s in ("standard", "minmax", "none")])
def test_scaling_describes_the_imputed_column(spark, impute, scaling):
    raw = [1.0, 3.0, None, 10.0, None, 4.0]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, x double")
    prep = fit_prep(df, ["x"], [], AnalysisConfig(numeric_impute=impute, scaling=scaling))["all"]
    present = np.array([v for v in raw if v is not None])
    fill = {"median": np.median(present), "mean": present.mean(), "constant": 0.0}[impute]
    x = np.array([fill if v is None else v for v in raw])
    want = {"standard": (x - x.mean()) / x.std(), "minmax": (x - x.min()) / (x.max() - x.min()), "none": x}[scaling]
    assert [v[0] for v in vectors(df, prep)] == pytest.approx(want.tolist())


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 7.0, None, None) for i in range(4)], "i int, flat double, gone double, none string")
    for scaling in ("standard", "minmax"):
        prep = fit_prep(df, ["flat", "gone"], ["none"], AnalysisConfig(scaling=scaling))["all"]
        assert prep.feature_names == ["flat"] and vectors(df, prep) == [[0.0]] * 4


def test_fold_statistics_come_from_fold_rows_only(spark):
    rows = [(i, i % 2, float(i), "x" if i % 2 else "y") for i in range(10)]
    df = spark.createDataFrame(rows, "i int, fold int, n double, c string")
    both = fit_prep(df, ["n"], ["c"], AnalysisConfig(), {"0": F.col("fold") != 0, "1": F.col("fold") != 1})
    for f in (0, 1):
        alone = fit_prep(df.where(F.col("fold") != f), ["n"], ["c"], AnalysisConfig())["all"]
        assert both[str(f)] == alone
    assert both["0"].feature_names == ["n", "c=x"]


def test_inside_a_pipeline(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], 3.0 * i + i % 2) for i in range(40)], "n double, c string, y double")
    prep = TablePrep(["n"], ["c"], AnalysisConfig())
    model = Pipeline(stages=[prep, LinearRegression(labelCol="y")]).fit(df)
    assert model.transform(df).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-6


def test_pipeline_stage(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(6)], "i int, n double, c string")
    model = TablePrep(["n"], ["c"], AnalysisConfig(), scale=False).fit(df)
    assert vectors(df, model.prep)[3] == [3.0, 0.0, 1.0]
    assert "features" in model.transform(df).columns


def test_clean_frame(spark):
    rows = [(None if i == 0 else i * 1.0, f"{i},000", ["2024-01-05", "bad"][i % 3 == 0], "2024-02-01", f"k{i}",
             i % 3, 1e9 if i == 5 else i * 1.0, True) for i in range(60)]
    df = spark.createDataFrame(
        rows, "y double, amount string, mixed string, `day.of` string, id string, code int, skew double, flag boolean")
    config = AnalysisConfig(target="y", exclude_columns=("flag", "y"), column_types={"mixed": "datetime"})
    c = clean_frame(df, profile_table(df, overrides={"mixed": "datetime", "day.of": "datetime"}), config)
    assert c.numeric_features == ["amount", "mixed_year", "mixed_month", "mixed_day", "mixed_weekday", "skew"]
    assert c.categorical_features == ["code"] and c.numeric_levels == {"code"}
    assert c.df.columns[0] == "y" and c.df.count() == 59
    assert c.df.agg(F.max("skew")).first()[0] < 1e6
    steps = {(e.step, e.target): e.n for e in c.log}
    assert steps["outliers", "skew"] == 1 and steps["drop rows", "y"] == 1 and ("drop column", "day.of") in steps
    assert steps["missing values", "mixed_year"] == 19


def test_dates_below_half_are_dropped_and_logged(spark):
    rows = [(float(i), "2024-01-05" if i % 3 == 0 else "x") for i in range(30)]
    df = spark.createDataFrame(rows, "y double, d string")
    config = AnalysisConfig(target="y", column_types={"d": "datetime"})
    c = clean_frame(df, profile_table(df, overrides={"d": "datetime"}), config)
    assert c.features == [] and [e.detail for e in c.log if e.target == "d"] == ["single value"] or any(
        "too few readable dates" in e.detail for e in c.log)


def test_limits_use_the_remaining_rows(spark):
    rows = [(float(i) if i < 50 else None, float(i) if i < 50 else 1000.0 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "y double, x double")
    c = clean_frame(df, profile_table(df), AnalysisConfig(target="y"))
    assert c.df.agg(F.max("x")).first()[0] == 49.0 and not [e for e in c.log if e.step == "outliers"]
