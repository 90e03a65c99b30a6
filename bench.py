"""Headline timings: one JSON line. Sizes by $BENCH_SF_DIR, threads by $BENCH_CPUS.

The table is loaded, spread over the threads and cached first (timed as `load`), as the files of the
test data are single row groups; everything after that runs on the cached table."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens import AnalysisConfig, ModelSettings, clean_frame, fit_prep, prepare_rows, profile_table, run_comparison
from tablelens import config as C
from tablelens.operators import charts, correlation, knn, metrics, split
from tablelens.operators.duplicates import count_duplicates

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
LIGHT = ModelSettings(n_trees=20, forest_depth=6, forest_bins=32, boosting_rounds=10, hist_bins=64, max_iter=100, parallelism=4)
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(CPUS)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablelens-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def load(spark: SparkSession, name: str) -> DataFrame:
    df = spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(CPUS).cache()
    df.count()
    return df


def wide_lines(lines: DataFrame) -> DataFrame:
    """40 numeric columns; every seventh value of a column is missing."""
    base = [c for c, t in lines.dtypes if t in ("bigint", "int", "double")]
    wide = lines.select(*[
        F.when(F.pmod(F.col("l_orderkey") + i, F.lit(7)) != 0, F.pow(F.col(base[i % len(base)]).cast("double") + i, F.lit(0.5 + i / 40)))
        .alias(f"n{i}") for i in range(40)]).cache()
    wide.count()
    return wide


def correlation_40(wide: DataFrame) -> None:
    row = wide.agg(*[F.struct(F.avg(n), F.stddev_samp(n)).alias(n) for n in wide.columns]).first()
    drain(correlation.correlation_matrix(wide, wide.columns, {n: tuple(row[n]) for n in wide.columns}))


def clean_encode(lines: DataFrame, profile) -> None:
    config = AnalysisConfig(target="l_extendedprice", exclude_columns=("l_orderkey",))
    clean = clean_frame(lines, profile, config)
    prep = fit_prep(clean.df, clean.numeric_features, clean.categorical_features, config)["all"]
    drain(prep.transform(clean.df))


def splits(lines: DataFrame) -> None:
    n = lines.count()
    drain(split.holdout_split(lines, LINE_KEY, n).assign(lines, "part"))
    drain(split.stratified_kfold(lines, "l_returnflag", LINE_KEY, 5).assign(lines, "fold"))


def ranking(lines: DataFrame) -> None:
    rows = lines.select(F.col("l_extendedprice").alias("score"), (F.col("l_quantity") > 25).alias("positive"))
    drain(metrics.roc_auc(rows))
    drain(metrics.roc_curve(rows))


def neighbours(customers: DataFrame) -> None:
    rows = split.holdout_split(customers, ["c_custkey"], customers.count()).assign(customers, "part").select(
        F.col("c_custkey").cast("string").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("v"),
        F.col("c_acctbal").alias("y"), "part")
    found = knn.nearest(rows.where("part = 0").select(F.col("id").alias("qid"), "v"),
                        rows.where("part = 1").select(F.col("id").alias("tid"), "v", "y"), 5)
    drain(knn.mean_of_neighbours(found))


def compare_models(orders: DataFrame) -> None:
    config = AnalysisConfig(target="o_orderstatus", key_columns=("o_orderkey",), cv_folds=3, max_models=4, models=LIGHT)
    clean = clean_frame(orders, profile_table(orders, count_duplicate_rows=False), config)
    result = run_comparison(prepare_rows(clean, config, C.CLASSIFICATION), config, C.CLASSIFICATION)
    drain(result.importance)


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    kept: dict[str, object] = {}

    def run(name: str, fn: Callable[[], object]) -> None:
        started = time.perf_counter()
        kept[name] = fn()
        times[name] = round(time.perf_counter() - started, 3)

    run("load_lineitem", lambda: load(spark, "lineitem"))
    lines = kept["load_lineitem"]
    run("profile_lineitem", lambda: profile_table(lines, count_duplicate_rows=False))
    run("duplicate_rows", lambda: count_duplicates(lines))
    run("load_wide", lambda: wide_lines(lines))
    run("correlation_40", lambda: correlation_40(kept["load_wide"]))
    run("histograms_and_boxes", lambda: [drain(charts.numeric_histograms(lines, kept["profile_lineitem"])),
                                         drain(charts.box_stats(lines, kept["profile_lineitem"]))])
    run("clean_encode_lineitem", lambda: clean_encode(lines, kept["profile_lineitem"]))
    run("splits_lineitem", lambda: splits(lines))
    run("roc_lineitem", lambda: ranking(lines))
    run("load_orders", lambda: load(spark, "orders"))
    run("compare_models_orders", lambda: compare_models(kept["load_orders"]))
    run("load_customer", lambda: load(spark, "customer"))
    run("knn_customer", lambda: neighbours(kept["load_customer"]))
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
