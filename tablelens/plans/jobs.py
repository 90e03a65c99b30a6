"""Entry points: analyse a table, or a path."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import findings as find
from ..operators import profile as prof
from ..operators.charts import chart_tables, left_out
from ..operators.clean import CleanTable, clean_frame, log_table
from ..operators.compare import ModelingResult, leaderboard_display, prepare_rows, run_comparison
from ..operators.correlation import top_correlations
from ..operators.typing_rules import suggest_task_type
from ..sources.load import load_table
from ..sources.tidy import preview
from . import report

PREVIEW_ROWS = 10
REPORT_PAIRS = 12


@dataclass
class AnalysisResult:
    """Everything an analysis found. Tables are DataFrames; small ones are already computed."""

    profile: prof.TableProfile
    clean: CleanTable
    task: str
    charts: dict[str, DataFrame]
    findings: DataFrame
    modeling: ModelingResult | None = None
    messages: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: The tables as they are read: cells as text, and whether rows were left out.
    display: dict[str, DataFrame] = field(default_factory=dict)
    report_path: str | None = None

    @property
    def has_model(self) -> bool:
        return self.modeling is not None


def analyze(
    df: DataFrame, config: C.AnalysisConfig, *, source_meta: dict[str, str] | None = None,
    load_notes: list[str] | None = None, output: str | None = None,
) -> AnalysisResult:
    """Profile, prepare, compare models if there is a target, and lay the results out as report tables.
    With `output` the tables are written below that folder."""
    spark = df.sparkSession
    meta = source_meta or {}
    messages: list[str] = []
    overrides = {n: t for n, t in config.column_types.items() if t != C.EXCLUDE}
    profile = prof.profile_table(df, overrides=overrides)

    if config.target and config.target not in df.columns:
        messages.append(f"there is no column '{config.target}'; only an exploration was made")
        config = replace(config, target=None)
    task = config.analysis_type
    if task in ("auto", ""):
        task = suggest_task_type(df, config.target)
        if config.target:
            messages.append(f"'{config.target}' was taken for a {task} target, judging by its values")
    if not config.target:
        task = C.EDA

    clean = clean_frame(df, profile, config)
    modeling = None
    if task in (C.REGRESSION, C.CLASSIFICATION):
        if not clean.features:
            messages.append("there is no usable feature; only an exploration was made")
            task = C.EDA
        else:
            try:
                modeling = run_comparison(prepare_rows(clean, config, task), config, task)
                messages += modeling.notes
            except (ValueError, RuntimeError) as exc:  # no usable rows or no fitted candidate; a failing cluster is no such case
                messages.append(f"modelling did not finish, only an exploration was made ({exc})")
                task = C.EDA

    messages += left_out(profile, config.target, task, config)
    charts = chart_tables(df, profile, target=config.target, task=task, modeling=modeling, top_features=config.top_features,
                          limits=config)
    result = AnalysisResult(
        profile, clean, task, charts, find.all_findings(profile, meta.get("source", "data"), modeling), modeling, messages)
    now = datetime.datetime.now()
    result.tables = report_tables(result, df, config, meta, load_notes or [], now)
    result.display = {name: report.display_table(table) for name, table in result.tables.items() if not name.startswith("chart_")}
    if output:
        result.report_path = report.write_report_tables(spark, result.tables, output, now=now, display=result.display)
    return result


def report_tables(
    result: AnalysisResult, df: DataFrame, config: C.AnalysisConfig, meta: dict[str, str], load_notes: list[str],
    now: datetime.datetime,
) -> dict[str, DataFrame]:
    """All report tables by name."""
    spark = df.sparkSession
    profile, modeling = result.profile, result.modeling
    frame = profile.frame()
    out = {
        "cover": report.cover_table(spark, config, result.task, meta, now),
        "table_summary": profile.summary(), "overview": prof.overview_table(frame),
        "preparation": log_table(spark, result.clean.log), "settings": report.settings_table(spark, config),
    }
    sections = {r["section"] for r in result.findings.select("section").distinct().collect()}
    for s in sections:
        name = "summary" if s == "summary" else f"findings_{s}"
        out[name] = result.findings.where(f"section = '{s}'").drop("section")
    if load_notes:
        out["load_notes"] = spark.createDataFrame(list(enumerate(load_notes)), "ord int, note string")
    if result.messages:
        out["messages"] = spark.createDataFrame(list(enumerate(result.messages)), "ord int, message string")
    if config.include_raw_preview:
        out["preview"] = preview(df, PREVIEW_ROWS, list(config.key_columns))
    if profile.names_by_type(C.NUMERIC):
        out["describe"] = prof.numeric_describe_table(frame)
    if profile.names_by_type(C.CATEGORICAL):
        out["categorical"] = prof.categorical_table(frame, config.categorical_rows)
    corr = profile.correlation()
    if corr is not None:
        out["top_correlations"] = top_correlations(corr, REPORT_PAIRS)
    out.update({f"chart_{k}": v for k, v in result.charts.items()})
    if modeling is not None:
        out["leaderboard"] = leaderboard_display(modeling.leaderboard)
        out["holdout"] = modeling.metrics.selectExpr("metric", "round(value, 4) AS value")
        out["importance"] = modeling.importance.limit(config.top_features)
    return out


def analyze_path(
    spark: SparkSession, path: str, config: C.AnalysisConfig, *, sheet_name: str | None = None, output: str | None = None
) -> AnalysisResult:
    """Load a file, folder or glob and analyse it."""
    loaded = load_table(spark, path, sheet_name=sheet_name)
    return analyze(loaded.df, config, source_meta=loaded.meta_dict(), load_notes=loaded.notes, output=output)
