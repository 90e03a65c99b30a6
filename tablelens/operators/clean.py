"""Cleaning a table into features: drops, type repair, date parts, winsorising, and the log of all that."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import NUMBER_TYPES, field_type, number_of, ref
from ..functions.dates import date_parts, to_datetime
from .profile import TableProfile, count_outside, has_spread, iqr_fences
from .quantiles import AGGREGATE_WIDTH, exact_quantiles

LOG_SCHEMA = "ord int, step string, target string, detail string, n bigint"

# How each imputation setting is described in the log.
FILL_NAMES = {
    "median": "median", "mean": "mean", "constant": "constant 0", "most_frequent": "most frequent value",
}


@dataclass(frozen=True)
class LogEntry:
    step: str
    target: str
    detail: str
    n: int | None = None


@dataclass
class CleanTable:
    """Cleaned rows: key columns, target, features. Numeric features are doubles, categories strings."""

    df: DataFrame
    numeric_features: list[str]
    categorical_features: list[str]
    #: Categories stored as numbers: their levels sort as numbers.
    numeric_levels: frozenset[str] = frozenset()
    log: list[LogEntry] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.numeric_features + self.categorical_features


# -- single operators --------------------------------------------------------------------------------
def columns_to_drop(profile: TableProfile, config: C.AnalysisConfig) -> dict[str, str]:
    """Excluded columns with the reason; the target always stays."""
    out: dict[str, str] = {}
    names = {c.name for c in profile.columns}
    for n in config.exclude_columns:
        if n in names and n != config.target:
            out[n] = "excluded by the user"
    for c in profile.columns:
        if c.name == config.target or c.name in out:
            continue
        if config.column_types.get(c.name) == C.EXCLUDE:
            out[c.name] = "excluded by the user"
        elif c.exclusion_reason:
            out[c.name] = f"excluded automatically ({c.exclusion_reason})"
    return out


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(ref(target).isNotNull())


def expand_dates(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace date columns by year, month, day and weekday (Monday 0) as doubles."""
    parts = [
        p.alias(f"{n}_{suffix}") for n in names
        for suffix, p in date_parts(to_datetime(n, field_type(df, n))).items()
    ]
    return df.select(*[ref(c) for c in df.columns if c not in names], *parts)


def unused_names(names: list[str], taken: set[str]) -> list[str]:
    """The names, with underscores added where one is already taken; they count as taken from now on."""
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def fit_winsor(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """IQR limits of the named numeric columns; a column without spread has no limits."""
    exprs = {n: number_of(df, n) for n in names}
    counts = value_counts(df, exprs)
    quartiles = exact_quantiles(df, exprs, counts)
    fences = {n: iqr_fences(q) for n, q in quartiles.items()}
    return {n: f for n, f in fences.items() if has_spread(f)}


def winsorised(x: Column, low: float, high: float) -> Column:
    """x moved onto the limits; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def apply_winsor(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        winsorised(number_of(df, c), *limits[c]).alias(c) if c in limits else ref(c) for c in df.columns])


def value_counts(df: DataFrame, exprs: dict[str, Column]) -> dict[str, int]:
    """Present values per expression."""
    out: dict[str, int] = {}
    names = list(exprs)
    for i in range(0, len(names), AGGREGATE_WIDTH):
        chunk = names[i : i + AGGREGATE_WIDTH]
        row = df.agg(*[F.count(exprs[n]).alias(str(k)) for k, n in enumerate(chunk)]).first()
        out.update({n: row[k] for k, n in enumerate(chunk)})
    return out


def missing_plan(df: DataFrame, numeric: list[str], categorical: list[str], config: C.AnalysisConfig) -> DataFrame:
    """(name, fill, n_missing) for every feature with gaps: what imputation will do."""
    how = {n: FILL_NAMES.get(config.numeric_impute, config.numeric_impute) for n in numeric}
    how.update({n: _category_fill(config) for n in categorical})
    counted = df.agg(*[F.count_if(ref(n).isNull()).alias(n) for n in how])
    return (
        counted.unpivot([], [ref(n) for n in how], "name", "n_missing").where(F.col("n_missing") > 0)
        .select("name", F.create_map(*[F.lit(v) for item in how.items() for v in item])[F.col("name")].alias("fill"),
                "n_missing")
    )


def _category_fill(config: C.AnalysisConfig) -> str:
    if config.categorical_impute == "constant":
        return f"constant '{C.MISSING_LABEL}'"
    return FILL_NAMES.get(config.categorical_impute, config.categorical_impute)


def log_table(spark: SparkSession, log: list[LogEntry]) -> DataFrame:
    """The preparation log in order; one placeholder row when nothing had to be done."""
    entries = log or [LogEntry("none", "-", "no preparation was needed")]
    return spark.createDataFrame([(i, e.step, e.target, e.detail, e.n) for i, e in enumerate(entries)], LOG_SCHEMA)


# -- the whole cleaning ------------------------------------------------------------------------------
def clean_frame(df: DataFrame, profile: TableProfile, config: C.AnalysisConfig) -> CleanTable:
    """Apply all cleaning steps as one projection over the input."""
    target = config.target if config.target in df.columns else None
    dropped = columns_to_drop(profile, config)
    log = [LogEntry("drop column", n, dropped[n]) for n in sorted(dropped)]
    converted, expanded, clipped, filled = [], [], [], []

    rows = df
    lost = 0
    if target:
        rows = drop_missing_target(df, target)
        lost = profile[target].n_missing

    numbers: dict[str, Column] = {}
    categories: dict[str, Column] = {}
    numeric_levels = set()
    dates: dict[str, list[str]] = {}
    taken = set(df.columns)
    for c in profile.columns:
        n = c.name
        if n == target or n in dropped or n in config.key_columns:
            continue
        kind = config.column_types.get(n) or c.semantic_type
        dtype = field_type(df, n)
        if kind == C.NUMERIC:
            numbers[n] = number_of(df, n)
            if not isinstance(dtype, NUMBER_TYPES):
                converted.append(LogEntry("convert type", n, "text to number"))
        elif kind == C.DATETIME:
            parts = date_parts(to_datetime(n, dtype))
            dates[n] = unused_names([f"{n}_{suffix}" for suffix in parts], taken)
            numbers.update(zip(dates[n], parts.values()))
        elif kind in (C.TEXT, C.EXCLUDE, C.UNSUPPORTED):
            log.append(LogEntry("drop column", n, "text or identifier"))
        else:
            categories[n] = ref(n).cast("string")
            if isinstance(dtype, NUMBER_TYPES):
                numeric_levels.add(n)

    counts = value_counts(rows, {**numbers, **categories, "\0rows": F.lit(1)}) if numbers or categories else {}
    n_rows = counts.get("\0rows", 0)
    for n, parts in dates.items():
        if n_rows and counts[parts[0]] / n_rows >= C.DATE_FEATURE_SHARE:
            expanded.append(LogEntry("date parts", n, "year, month, day and weekday"))
        else:
            log.append(LogEntry("drop column", n, "too few readable dates"))
            for p in parts:
                del numbers[p]

    if config.handle_outliers and config.outlier_method == "iqr" and numbers:
        limits = _winsor_limits(rows, numbers, counts, profile, lost)
        outside = count_outside(rows, numbers, limits)
        for n in list(numbers):
            if outside[n] > 0:
                numbers[n] = winsorised(numbers[n], *limits[n])
                clipped.append(LogEntry("outliers", n, "moved onto the IQR limits", outside[n]))

    for n in [*numbers, *categories]:
        if n_rows - counts[n]:
            how = FILL_NAMES.get(config.numeric_impute, config.numeric_impute) if n in numbers else _category_fill(config)
            filled.append(LogEntry("missing values", n, f"filled with {how}", n_rows - counts[n]))

    log += converted + expanded + clipped + filled
    if lost:
        log.append(LogEntry("drop rows", target, "missing target", lost))
    if not numbers and not categories:
        log.append(LogEntry("note", "-", "no usable feature; check the exclusions"))

    keep = [ref(k) for k in config.key_columns] + ([ref(target)] if target and target not in config.key_columns else [])
    out = rows.select(*keep, *[x.alias(n) for n, x in numbers.items()], *[x.alias(n) for n, x in categories.items()])
    return CleanTable(out, list(numbers), list(categories), frozenset(numeric_levels), log)


def _winsor_limits(
    rows: DataFrame, numbers: dict[str, Column], counts: dict[str, int], profile: TableProfile, lost: int
) -> dict[str, tuple[float, float] | None]:
    """Limits over the remaining rows. Without lost rows those of the profile are already right."""
    known = {}
    if not lost:
        known = {c.name: (c.low_bound, c.high_bound) for c in profile.columns
                 if c.semantic_type == C.NUMERIC and c.low_bound is not None}
    wanted = {n: x for n, x in numbers.items() if n not in known}
    quartiles = exact_quantiles(rows, wanted, {n: counts[n] for n in wanted})
    return {n: known[n] if n in known else iqr_fences(quartiles[n]) for n in numbers}
