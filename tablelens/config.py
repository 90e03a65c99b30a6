"""Analysis settings and the fixed thresholds of the typing and cleaning rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds of the analysis rules.
CATEGORICAL_MAX_DISTINCT = 20
IDENTIFIER_RATIO = 0.5
MAX_MISSING_RATIO = 0.6
MAX_TARGET_CLASSES = 20
ONEHOT_MAX_LEVELS = 30
RARE_LEVEL_SHARE = 0.01
NUMERIC_TEXT_SHARE = 0.95
DATE_MARK_SHARE = 0.6
DATE_PARSE_SHARE = 0.9
DATE_FEATURE_SHARE = 0.5
FENCE_FACTOR = 1.5

# How delimited text files are probed.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin1")
SEPARATORS = (",", ";", "\t", "|")

# Fixed value: what a missing category is called when it is filled with a constant.
MISSING_LABEL = "미상"

# Semantic column types.
NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
TEXT = "text"
EXCLUDE = "exclude"
UNSUPPORTED = "unsupported"

# Task types.
REGRESSION = "regression"
CLASSIFICATION = "classification"
EDA = "eda"


@dataclass(frozen=True)
class ModelSettings:
    """Size limits of the MLlib estimators. `forest_depth` bounds trees MLlib cannot grow without limit."""

    n_trees: int = 300
    forest_depth: int = 12
    forest_bins: int = 64
    tree_depth: int = 8
    tree_bins: int = 256
    boosting_rounds: int = 100
    boosting_step: float = 0.1
    boosting_depth: int = 3
    hist_depth: int = 5
    hist_bins: int = 256
    max_iter: int = 2000
    neighbours: int = 5
    #: Candidates fitted at the same time. Each keeps its own copy of the rows in memory.
    parallelism: int = 2


@dataclass(frozen=True)
class AnalysisConfig:
    """Everything a user can choose for one analysis."""

    analysis_type: str = "auto"
    target: str | None = None
    exclude_columns: tuple[str, ...] = ()
    column_types: dict[str, str] = field(default_factory=dict)
    #: Columns that identify a row. Without them a row id is generated and frozen in a staged copy.
    key_columns: tuple[str, ...] = ()

    numeric_impute: str = "median"
    categorical_impute: str = "most_frequent"
    handle_outliers: bool = True
    outlier_method: str = "iqr"
    scaling: str = "standard"

    test_size: float = 0.2
    cv_folds: int = 5
    random_state: int = 42
    max_models: int = 8
    compute_importance: bool = True
    #: How often each column is shuffled for its importance, whatever the number of rows.
    importance_repeats: int = 5
    models: ModelSettings = ModelSettings()

    report_title: str = "Automatic data analysis report"
    report_subtitle: str = ""
    author: str = ""
    organization: str = ""
    include_raw_preview: bool = True
    top_features: int = 15
    #: How much the charts and tables show; a message names what a limit leaves out.
    histogram_columns: int = 6
    box_columns: int = 8
    categorical_rows: int = 30
    shown_classes: int = 20
    group_charts: int = 2
    group_rows: int = 12
