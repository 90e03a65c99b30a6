"""Automatic analysis of flat tables on Spark."""

from .config import AnalysisConfig, ModelSettings
from .functions.staging import temporary_copies
from .operators.charts import chart_tables
from .operators.clean import clean_frame
from .operators.compare import ModelingResult, prepare_rows, run_comparison
from .operators.encode import TablePrep, TablePrepModel, fit_prep
from .operators.profile import TableProfile, profile_table
from .operators.typing_rules import infer_column_type, suggest_task_type
from .plans.jobs import AnalysisResult, analyze, analyze_path
from .plans.report import write_report_tables
from .sources.load import load_table
from .sources.tidy import LoadError, LoadResult
from .sources.workbook import list_sheets

__all__ = [
    "AnalysisConfig", "AnalysisResult", "LoadError", "LoadResult", "ModelSettings", "ModelingResult", "TablePrep",
    "TablePrepModel", "TableProfile", "analyze", "analyze_path", "chart_tables", "clean_frame", "fit_prep",
    "infer_column_type", "list_sheets", "load_table", "prepare_rows", "profile_table", "run_comparison",
    "suggest_task_type", "temporary_copies", "write_report_tables",
]
