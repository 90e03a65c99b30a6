"""Typing and profiling on literal frames."""

import datetime
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens import infer_column_type, profile_table, suggest_task_type
from tablelens.operators import correlation
from tablelens.operators.correlation import correlation_matrix, top_correlations
from tablelens.operators.duplicates import count_duplicates
from tablelens.operators.profile import overview_table

RNG = np.random.default_rng(0)
DAYS = [f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(200)]


@pytest.mark.parametrize("values, sql_type, expected", [
    ([float(v) for v in RNG.normal(size=200)], "double", "numeric"),
    ([1, 2, 3] * 50, "int", "categorical"),
    (["seoul", "busan", "daegu"] * 40, "string", "categorical"),
    ([f"ID{i:05d}" for i in range(300)], "string", "text"),
    ([f"{i + 1},000" for i in range(200)], "string", "numeric"),
    (DAYS, "string", "datetime"),
    ([f"{i % 7},000" for i in range(200)], "string", "categorical"),
    ([True, False] * 10, "boolean", "categorical"),
    ([None] * 5, "string", "text"),
    ([None] * 5, "double", "text"),
    ([datetime.date(2024, 1, 1)] * 3, "date", "datetime"),
    ([0.5, 1.5] * 50, "double", "numeric"),
    ([1.0, 2.0, float("inf")] * 5, "double", "categorical"),
    ([float("nan"), 1.0, 2.0] * 5, "double", "categorical"),
    ([f"{i}D" for i in range(100)], "string", "text"),
    (["2024년 1월 5일", "2024년 2월 6일"] * 30, "string", "datetime"),
])
def test_column_types(spark, values, sql_type, expected):
    df = spark.createDataFrame([(v,) for v in values], f"`col.x` {sql_type}")
    assert infer_column_type(df, "col.x") == expected
    assert profile_table(df, count_duplicate_rows=False)["col.x"].semantic_type == expected


def test_task_types(spark):
    rows = [(float(v), "ABC"[i % 3], i % 2, None) for i, v in enumerate(RNG.gamma(2, size=300))]
    df = spark.createDataFrame(rows, "price double, grade string, flag int, gone double")
    assert [suggest_task_type(df, t) for t in ("price", "grade", "flag", None, "gone", "absent")] == [
        "regression", "classification", "classification", "eda", "eda", "eda"]
    text = spark.createDataFrame([(f"{i},000",) for i in range(1, 60)], "t string")
    assert suggest_task_type(text, "t") == "regression"


def test_numeric_statistics_match_pandas(spark):
    values = [float(v) for v in RNG.lognormal(size=500)] + [None, float("nan")]
    p = profile_table(spark.createDataFrame([(v,) for v in values], "x double"))["x"]
    s = pd.Series(values, dtype="float64")
    assert p.n_missing == 2 and p.n_unique == s.nunique()
    for got, want in ((p.mean, s.mean()), (p.std, s.std()), (p.q1, s.quantile(0.25)), (p.median, s.median()),
                      (p.q3, s.quantile(0.75)), (p.skewness, s.skew()), (p.minimum, s.min()), (p.maximum, s.max())):
        assert got == pytest.approx(want, rel=1e-9)
    reach = 1.5 * (s.quantile(0.75) - s.quantile(0.25))
    assert p.n_outliers == int(((s < s.quantile(0.25) - reach) | (s > s.quantile(0.75) + reach)).sum()) > 0


def test_degenerate_columns(spark):
    one = profile_table(spark.createDataFrame([(1.5, "a")], "x double, s string"), overrides={"x": "numeric"})["x"]
    assert (one.mean, one.std, one.skewness, one.median, one.n_outliers) == (1.5, None, None, 1.5, 0)
    two = profile_table(spark.createDataFrame([(1.0,), (2.0,)], "x double"), overrides={"x": "numeric"})["x"]
    assert two.skewness is None and two.median == 1.5
    flat = profile_table(spark.createDataFrame([(0.1,)] * 30, "x double"), overrides={"x": "numeric"})["x"]
    assert flat.skewness == 0.0 and flat.n_outliers == 0 and (flat.low_bound, flat.high_bound) == (0.1, 0.1)
    assert flat.exclusion_reason == "single value"
    empty = profile_table(spark.createDataFrame([], "x double, s string"))
    assert empty.n_rows == 0 and empty["x"].missing_ratio == 0.0 and empty.n_duplicated_rows == 0


def test_no_spread_means_no_outliers(spark):
    df = spark.createDataFrame([(5.0 if i % 10 else i + 0.5,) for i in range(300)], "x double")
    c = profile_table(df)["x"]
    assert c.q1 == c.q3 == 5.0 and c.n_outliers == 0


def test_mode_ties_and_samples(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "c", None]], "s string")
    c = profile_table(df)["s"]
    assert (c.top_value, c.top_freq, c.sample_values) == ("a", 2, ["a", "b", "c"])


def test_long_texts_are_counted_and_shown_whole(spark):
    long = ["x" * 500, "x" * 499 + "y", "x" * 500]
    c = profile_table(spark.createDataFrame([(t,) for t in long], "t string"))["t"]
    assert c.n_unique == 2 and c.top_value == "x" * 500 and c.top_freq == 2


def test_edge_table_exclusions_and_unsupported(spark):
    rows = [(None, "same", f"NO{i:06d}", "abc"[i % 3], [1.0]) for i in range(220)]
    p = profile_table(spark.createDataFrame(rows, "`전부결측` double, `상수컬럼` string, `식별번호` string, `구분` string, arr array<double>"))
    assert [c.name for c in p.columns if c.exclusion_reason] == ["전부결측", "상수컬럼", "식별번호", "arr"]
    assert p["arr"].semantic_type == "unsupported"
    assert overview_table(p.frame()).count() == 5


def test_large_integers_stay_apart(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(30)], "x bigint")
    assert profile_table(df)["x"].n_unique == 30


def test_zoneless_and_zoned_times(spark):
    df = spark.sql("""SELECT timestamp_ntz'2024-03-10 02:30:00.25' AS a, timestamp'2024-03-10 02:30:00' AS b
                      UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.5', timestamp'1969-12-31 23:59:59'""")
    p = profile_table(df)
    assert p["a"].sample_values == ["1969-12-31 23:59:59.500000", "2024-03-10 02:30:00.250000"]
    assert p["b"].sample_values == ["1969-12-31 23:59:59", "2024-03-10 02:30:00"]


def test_duplicates_with_nulls_and_hot_row(spark):
    rows = [(None, 1), (None, 1), (1, None), (1, None), (1, None), (2, 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert count_duplicates(df) == (6, 3)
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"))
    assert count_duplicates(hot) == (3000, 999)


@pytest.mark.parametrize("k", [4, 11])
def test_correlation_matches_pandas(spark, k):
    data = RNG.normal(size=(300, k)) * 1e3 + 1e6
    data[RNG.random((300, k)) < 0.1] = np.nan
    data[:, 1] = 7.0
    names = [f"c.{i}" for i in range(k)]
    pdf = pd.DataFrame(data, columns=names)
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in data],
                               ", ".join(f"`{n}` double" for n in names))
    got = correlation_matrix(df, names, {n: (float(pdf[n].mean()), float(pdf[n].std())) for n in names})
    want = pdf.corr()
    cells = {(r["var1"], r["var2"]): r["corr"] for r in got.collect()}
    assert len(cells) == k * k
    for a in names:
        for b in names:
            if names[1] in (a, b):
                assert cells[a, b] is None
            else:
                assert cells[a, b] == pytest.approx(want.loc[a, b], abs=1e-10)
    assert top_correlations(got, 3).count() == 3


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select(
        (F.col("id") * 7919 % 1009).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 41).alias("s"))
    a, b = (profile_table(df.repartition(n)).frame().drop("mean", "std", "skewness").collect() for n in (1, 17))
    assert a == b


@pytest.mark.parametrize("k, panel, tile", [(23, 7, 3), (130, 512, 64), (300, 100, 64), (9, 9, 64)])
def test_correlation_in_panels(spark, monkeypatch, k, panel, tile):
    monkeypatch.setattr(correlation, "TILE", tile)
    rng = np.random.default_rng(k)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, k)) + rng.normal(size=(80, k)) * 0.3 + 100
    x[:, 2] = 5
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = correlation.correlation_matrix(df, names, {n: (100.0, 1.0) for n in names}, panel=panel).toPandas()
    assert len(got) == k * k
    found = got.pivot(index="ord1", columns="ord2", values="corr").to_numpy(float)
    want = pd.DataFrame(x).corr().to_numpy()
    want[2], want[:, 2] = np.nan, np.nan
    assert np.allclose(found, want, equal_nan=True, atol=1e-8)


def test_no_task_sums_more_than_two_panels():
    first, second = range(0, 4), range(4, 8)
    batch = pa.RecordBatch.from_arrays([pa.array([1.0, 2.0, float("nan")])] * 8, names=[f"x{i}" for i in range(8)])
    rows = list(correlation._panel_products(first, second)([batch]))
    assert sum(len(raw) for b in rows for raw in b.column(2).to_pylist()) == 8 * len(correlation.SUMS) * 16
