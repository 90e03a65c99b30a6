"""Exact quantiles through brackets and narrowing."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.operators import frequencies
from tablelens.operators.quantiles import exact_quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def check(spark, columns, **kwargs):
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in columns)).repartition(3)
    exprs = {n: F.col(n) for n in columns}
    got = exact_quantiles(df, exprs, {n: len(rows) for n in columns}, probs=PROBS, **kwargs)
    for n, values in columns.items():
        assert got[n] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12), n


def sample(n=3000):
    rng = np.random.default_rng(3)
    return {
        "uniform": rng.random(n), "heavy": rng.lognormal(sigma=4, size=n), "hot": np.where(rng.random(n) < 0.34, 5.0, rng.random(n) * 10),
        "codes": rng.integers(0, 4, n), "flat": np.full(n, 2.5), "signed": rng.normal(size=n) * 1e9,
        "two": np.where(np.arange(n) < n // 2, 1.0, 1e12),
    }


def test_small_columns(spark):
    check(spark, sample(400))


def test_brackets(spark):
    check(spark, sample(), small=0, accuracy=200)


def test_brackets_that_miss_are_repaired(spark):
    check(spark, sample(500), small=0, accuracy=100_000)


def test_narrowing(spark):
    check(spark, sample(), small=0, accuracy=20, bracket_rows=5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, {"x": np.array(values) + 0.0}, small=0, accuracy=50, bracket_rows=3)


def test_infinities(spark):
    values = [float("-inf")] * 3 + [float(v) for v in range(200)] + [float("inf")] * 2
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, {"x": F.col("x")}, {"x": 205}, probs=(0.25, 0.5, 0.75), small=0, accuracy=5, bracket_rows=2)
    assert got["x"] == [48.0, 99.0, 150.0]


def test_wide_tables_are_read_in_groups(spark, monkeypatch):
    monkeypatch.setattr(frequencies, "EXPANDED_COLUMNS", 3)
    df = spark.range(40).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(10)])
    found = {r["col"]: r["n_unique"] for r in frequencies.frequency_summary(frequencies.frequency_table(df, df.columns)).collect()}
    assert found == {i: i + 2 for i in range(10)}


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, {"x": 0}) == {"x": [None, None, None]}
