"""Reading numbers and dates, and display text."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import staging
from tablelens.functions.columns import normalise_missing, ref, text_to_number, to_number
from tablelens.functions.dates import date_parts, text_to_datetime
from tablelens.functions.text import cell_text, shorten, significant


def evaluate(spark, values, fn, sql_type="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {sql_type}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("text, number", [
    ("3D", None), ("1d", None), ("1f", None), ("1_000", None), ("+5", 5.0), (" 12 ", 12.0), ("1,234.5", 1234.5), ("", None),
    (".5", 0.5), ("5.", 5.0), ("-1e3", -1000.0), ("inf", float("inf")), ("-Infinity", float("-inf")), ("nan", None),
    ("12 34", None), ("abc", None), (None, None), ("0x10", None)])
def test_text_to_number(spark, text, number):
    assert evaluate(spark, [text], text_to_number) == [number]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(to_number("x", T.DoubleType())).collect()] == [1.0, None, None]


def test_missing_tokens_only_touch_whole_cells(spark):
    df = spark.createDataFrame([("NA", 1.0), (" n/a ", float("nan")), ("NAVY", 2.0), ("", None)], "`a.b` string, x double")
    assert [tuple(r) for r in normalise_missing(df).collect()] == [(None, 1.0), (None, None), ("NAVY", 2.0), (None, None)]


@pytest.mark.parametrize("text, shown", [
    ("2024-01-05", "2024-01-05 00:00:00"), ("2024/1/5", "2024-01-05 00:00:00"), ("20240105", "2024-01-05 00:00:00"),
    ("01/05/2024", "2024-01-05 00:00:00"), ("25/12/2024", "2024-12-25 00:00:00"), ("2024년 1월 5일", "2024-01-05 00:00:00"),
    ("2024.01.05", "2024-01-05 00:00:00"), ("2024-01-05 10:11:12", "2024-01-05 10:11:12"),
    ("2024-01-05T10:11:12", "2024-01-05 10:11:12"), ("2024-01", "2024-01-01 00:00:00"), ("2024-13-45", None),
    ("hello", None), ("3D", None), (None, None), ("12/2024", None), ("2024-01-05x", None)])
def test_text_to_datetime(spark, text, shown):
    assert evaluate(spark, [text], lambda c: text_to_datetime(c).cast("string")) == [shown]


def test_date_parts_count_weekdays_from_monday(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS d UNION ALL SELECT timestamp_ntz'2024-03-03 23:59:59'")
    got = [tuple(r) for r in df.select(*date_parts(F.col("d")).values()).collect()]
    assert got == [(2024.0, 1.0, 1.0, 0.0), (2024.0, 3.0, 3.0, 6.0)]


@pytest.mark.parametrize("x", [0.0, 1.0, 12.0, 1234.0, 123.456, 0.00012345, 0.000012345, 12345.678, 9999.6, -3.14159, 1e10, 0.5])
def test_significant_matches_general_format(spark, x):
    assert evaluate(spark, [x], significant, "double") == [f"{x:,.4g}"]


def test_cell_text(spark):
    assert evaluate(spark, [None, 5.0, 1234567.0, 0.123456, -2.0], cell_text, "double") == ["-", "5", "1,234,567", "0.1235", "-2"]


def test_shorten(spark):
    assert evaluate(spark, ["a" * 22, "b" * 23, None], shorten) == ["a" * 22, "b" * 21 + "…", None]


def test_odd_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert df.select(ref("a.b"), ref("c`d")).first() == (1, 2)


def test_many_rows_in_one_task_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(staging, "TASK_ROWS", 100)
    rows = spark.range(1_000, numPartitions=1)
    assert staging.spread(rows).select(F.spark_partition_id()).distinct().count() == 4
    assert sorted(r[0] for r in staging.spread(rows).collect()) == list(range(1_000))
    assert staging.spread(spark.range(150, numPartitions=1)).rdd.getNumPartitions() == 1
    assert staging.spread(spark.range(1_000, numPartitions=7)).rdd.getNumPartitions() == 7


def test_many_rows_are_held_on_disk_and_removed(spark, monkeypatch):
    rows = spark.range(50).selectExpr("id", "id * 2 AS y")
    with staging.held(rows, 50) as few:
        assert few.storageLevel.useMemory and few.count() == 50
    monkeypatch.setattr(staging, "HELD_ROWS", 40)
    before = list(staging._paths)
    with staging.held(rows, 50) as many:
        assert not many.storageLevel.useMemory and len(many.inputFiles()) >= 1
        assert sorted(map(tuple, many.collect())) == [(i, 2 * i) for i in range(50)]
        path = staging._paths[-1]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and staging._paths == before
