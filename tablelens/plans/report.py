"""The report as tables: what belongs to it, how it is displayed, and where it is written."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import NUMBER_TYPES, field_type, ref
from ..functions.text import cell_text

MAX_TABLE_ROWS = 40
INDEX = "ord int, section string, title string, table_name string"

# Section titles and the tables in them, in report order. A table that a run lacks is left out.
SECTIONS = (
    ("0", "Cover", ("cover",)),
    ("1", "Summary", ("summary",)),
    ("2", "Data overview", ("findings_data", "load_notes", "table_summary", "overview", "preview", "chart_missing")),
    ("3", "Preparation", ("preparation",)),
    ("4", "Exploration", (
        "describe", "categorical", "chart_distribution", "chart_boxplot", "findings_correlation", "chart_correlation",
        "top_correlations", "chart_target", "chart_group_mean")),
    ("5", "Models", (
        "findings_modeling", "leaderboard", "chart_model_comparison", "holdout", "chart_confusion", "chart_roc",
        "chart_pred_actual", "chart_residual")),
    ("6", "Drivers", ("findings_importance", "chart_importance", "importance", "messages")),
    ("7", "Recommendations", ("findings_advice",)),
    ("A", "Settings", ("settings",)),
)


def display_table(df: DataFrame, max_rows: int = MAX_TABLE_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The first rows as text, every row saying whether more were left out."""
    ordered = df.orderBy(*order_by) if order_by else df
    # one row more than is shown tells whether there are others; these few rows are in one task
    first = ordered.limit(max_rows + 1).withColumn("_i", F.monotonically_increasing_id())
    first = first.withColumn("_last", F.max("_i").over(Window.partitionBy()))
    cells = []
    for c in df.columns:
        dtype = field_type(df, c)
        if isinstance(dtype, NUMBER_TYPES):
            cells.append(cell_text(ref(c).cast("double")).alias(c))
        elif isinstance(dtype, T.ArrayType):
            cells.append(F.concat_ws(", ", ref(c)).alias(c))
        else:
            cells.append(F.coalesce(ref(c).cast("string"), F.lit("-")).alias(c))
    return first.where(F.col("_i") < max_rows).select(*cells, (F.col("_last") >= max_rows).alias("truncated"))


def task_label(task: str, target: str | None) -> str:
    if task == C.EDA:
        return "exploratory data analysis"
    return f"{task} of '{target}'"


def cover_table(
    spark: SparkSession, config: C.AnalysisConfig, task: str, source_meta: dict[str, str], now: datetime.datetime
) -> DataFrame:
    rows = [("title", config.report_title), ("subtitle", config.report_subtitle or f"data: {source_meta.get('source', '-')}"),
            ("written", now.strftime("%Y-%m-%d %H:%M")), ("analysis", task_label(task, config.target)), *source_meta.items()]
    rows += [(k, v) for k, v in (("organization", config.organization), ("author", config.author)) if v]
    return spark.createDataFrame(rows, "item string, content string")


def settings_table(spark: SparkSession, config: C.AnalysisConfig) -> DataFrame:
    rows = [
        ("numeric imputation", config.numeric_impute), ("categorical imputation", config.categorical_impute),
        ("outliers", "moved onto the IQR limits" if config.handle_outliers else "left as they are"),
        ("scaling", config.scaling), ("test share", f"{config.test_size:.0%}"), ("folds", str(config.cv_folds)),
        ("seed", str(config.random_state)), ("models", str(config.max_models)),
    ]
    return spark.createDataFrame(rows, "item string, value string")


def report_index(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(section, title, name) for section, title, names in SECTIONS for name in names if name in tables]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], INDEX)


def run_folder(base: str, now: datetime.datetime) -> str:
    return f"{base.rstrip('/')}/run_id={now:%Y%m%d_%H%M%S}"


def write_report_tables(
    spark: SparkSession, tables: dict[str, DataFrame], base: str, *, now: datetime.datetime | None = None,
    source: str = "parquet", display: dict[str, DataFrame] | None = None,
) -> str:
    """Write every table of the report and its index under a folder named after the run, those in display form in its folder
    `display`; an existing run is never overwritten."""
    folder = run_folder(base, now or datetime.datetime.now())
    shown = {f"display/{name}": df for name, df in (display or {}).items()}
    for name, df in {**tables, **shown, "report_index": report_index(spark, tables)}.items():
        df.write.mode("errorifexists").format(source).save(f"{folder}/{name}")
    return folder
