"""Profiling a whole table: one wide aggregate, one (column, value) shuffle, one pass for the fences.

The driver only ever holds one small record per column; everything else stays in DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, make_dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import (
    NUMBER_TYPES, PROFILED_TYPES, STRING_TYPES, field_type, finite_or_none, number_of, present, ref,
)
from ..functions.staging import stage, together
from ..functions.text import significant
from . import frequencies as freq
from .correlation import correlation_matrix
from .duplicates import count_duplicates
from .quantiles import AGGREGATE_WIDTH, exact_quantiles
from .typing_rules import TypeEvidence, decide_type, has_more_numbers_than

#: With more numeric columns than this the correlation matrix is staged instead of kept on the driver.
LOCAL_MATRIX_COLUMNS = 40

PROFILE_SCHEMA = (
    "ordinal int, name string, semantic_type string, dtype string, n_missing bigint, missing_ratio double, "
    "n_unique bigint, unique_ratio double, sample_values array<string>, mean double, std double, minimum double, "
    "q1 double, median double, q3 double, maximum double, skewness double, n_outliers bigint, outlier_ratio double, "
    "low_bound double, high_bound double, top_value string, top_freq bigint, exclusion_reason string"
)


#: One row of the profile: the fields of PROFILE_SCHEMA, those without a value left out.
FIELDS = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
ColumnProfile = make_dataclass(
    "ColumnProfile", [(f, object, field(default={"n_outliers": 0, "outlier_ratio": 0.0, "exclusion_reason": ""}.get(f))) for f in FIELDS],
    frozen=True)


@dataclass
class TableProfile:
    """Records per column plus the table-wide counts. The correlation matrix is computed when first asked for."""

    source: DataFrame
    columns: list[ColumnProfile]
    n_rows: int
    n_cols: int
    size_mb: float
    n_duplicated_rows: int | None
    correlation_limit: int | None = None
    _correlation: DataFrame | None = field(default=None, repr=False)

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def names_by_type(self, kind: str) -> list[str]:
        return [c.name for c in self.columns if c.semantic_type == kind]

    # -- tables --------------------------------------------------------------------------------
    def frame(self) -> DataFrame:
        """The column profile, one row per column."""
        rows = [tuple(getattr(c, f) for f in FIELDS) for c in self.columns]
        return self.source.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)

    def summary(self) -> DataFrame:
        """One row of table-wide counts."""
        kinds = [len(self.names_by_type(k)) for k in (C.NUMERIC, C.CATEGORICAL, C.DATETIME, C.TEXT)]
        return self.source.sparkSession.createDataFrame(
            [(self.n_rows, self.n_cols, self.size_mb, self.n_duplicated_rows, *kinds,
              sum(c.n_missing > 0 for c in self.columns))],
            "n_rows bigint, n_cols int, size_mb double, n_duplicated_rows bigint, n_numeric int, n_categorical int, "
            "n_datetime int, n_text int, n_with_missing int",
        )

    def correlation(self) -> DataFrame | None:
        """Long Pearson matrix (ord1, var1, ord2, var2, corr) of all numeric columns, or the first if limited; or None."""
        names = self.names_by_type(C.NUMERIC)[: self.correlation_limit]
        if len(names) < 2:
            return None
        if self._correlation is None:
            matrix = correlation_matrix(self.source, names, {n: (self[n].mean, self[n].std) for n in names})
            # Kept, as several tables are made from it.
            self._correlation = (self.source.sparkSession.createDataFrame(matrix.collect(), matrix.schema)
                                 if len(names) <= LOCAL_MATRIX_COLUMNS else stage(matrix))
        return self._correlation


def profile_table(
    df: DataFrame,
    *,
    overrides: dict[str, str] | None = None,
    correlation_max_cols: int | None = None,
    count_duplicate_rows: bool = True,
) -> TableProfile:
    """Profile every column of `df`. `overrides` replaces inferred semantic types by name."""
    overrides = overrides or {}
    names = [f.name for f in df.schema.fields]
    readable = [n for n in names if isinstance(field_type(df, n), PROFILED_TYPES)]
    # Three reads of the table that do not depend on each other.
    (stats, n_rows), counted, n_dup = together(df.sparkSession, [
        lambda: _wide_aggregate(df, names), lambda: _frequency_records(df, readable),
        lambda: count_duplicates(df)[1] if count_duplicate_rows else None], 3)

    kinds: dict[str, str] = {}
    for n in names:
        kinds[n] = overrides.get(n) or decide_type(_evidence(df, n, stats[n], counted.get(n)))
    numeric = [n for n in names if kinds[n] == C.NUMERIC]
    exprs = {n: number_of(df, n) for n in numeric}
    stats_of_text = {n: e for n, e in exprs.items() if "n_number" not in stats[n]}
    for n, moments in _moments(df, stats_of_text).items():
        stats[n].update(moments)
    quartiles = exact_quantiles(df, exprs, {n: stats[n]["n_number"] for n in numeric})
    fences = {n: iqr_fences(quartiles[n]) for n in numeric}
    spread = _outliers_and_skewness(df, exprs, fences, stats)

    columns = []
    for k, n in enumerate(names):
        n_missing = n_rows - stats[n]["n_present"]
        found = counted.get(n, _NOTHING)
        c = ColumnProfile(
            ordinal=k, name=n, semantic_type=kinds[n], dtype=field_type(df, n).simpleString(),
            n_missing=n_missing, missing_ratio=n_missing / n_rows if n_rows else 0.0,
            n_unique=found.n_unique, unique_ratio=found.n_unique / n_rows if n_rows else 0.0,
            sample_values=[v for v, _ in found.top],
        )
        if kinds[n] == C.NUMERIC:
            s, (q1, q2, q3), (low, high) = stats[n], quartiles[n], fences[n] or (None, None)
            n_outliers, skewness = spread[n]
            c = replace(
                c, mean=finite_or_none(s["mean"]), std=finite_or_none(s["std"]),
                minimum=finite_or_none(s["lo"]), maximum=finite_or_none(s["hi"]),
                q1=q1, median=q2, q3=q3, skewness=skewness, n_outliers=n_outliers,
                outlier_ratio=n_outliers / n_rows if n_rows else 0.0, low_bound=low, high_bound=high,
            )
        elif found.top:
            c = replace(c, top_value=found.top[0][0], top_freq=found.top[0][1])
        columns.append(replace(c, exclusion_reason=exclusion_reason(c)))

    size = sum(s["n_bytes"] for s in stats.values()) / 1024 / 1024
    return TableProfile(df, columns, n_rows, len(names), size, n_dup, correlation_max_cols)


# -- passes ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class _Found:
    """What the frequency table says about one column."""

    n_unique: int = 0
    top: tuple[tuple[str, int], ...] = ()
    all_integral: bool = False
    n_number_text: int = 0
    n_date_marked: int = 0
    n_date_parsed: int = 0


_NOTHING = _Found()


def _evidence(df: DataFrame, name: str, stats: dict, found: _Found | None) -> TypeEvidence:
    dtype, n_present, found = field_type(df, name), stats["n_present"], found or _NOTHING
    numeric_text = n_present > 0 and found.n_number_text / n_present > C.NUMERIC_TEXT_SHARE
    return TypeEvidence(
        dtype=dtype, n_present=n_present, n_unique=found.n_unique, all_integral=found.all_integral,
        n_number=found.n_number_text,
        more_numbers_than_codes=numeric_text and has_more_numbers_than(df, name, C.CATEGORICAL_MAX_DISTINCT),
        n_date_marked=found.n_date_marked, n_date_parsed=found.n_date_parsed,
    )


def _moment_exprs(x: Column) -> dict[str, Column]:
    return {"n_number": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "lo": F.min(x), "hi": F.max(x)}


def _wide_aggregate(df: DataFrame, names: list[str]) -> tuple[dict[str, dict], int]:
    """Counts, sizes and moments of all columns in one code-generated aggregate; wide tables in chunks."""
    exprs: dict[str, dict[str, Column]] = {}
    for n in names:
        dtype = field_type(df, n)
        exprs[n] = {"n_present": F.count(present(n, dtype)), "n_bytes": logical_bytes(n, dtype)}
        if isinstance(dtype, NUMBER_TYPES):
            exprs[n].update(_moment_exprs(number_of(df, n)))
    return _aggregate(df, exprs)


def _moments(df: DataFrame, exprs: dict[str, Column]) -> dict[str, dict]:
    return _aggregate(df, {n: _moment_exprs(x) for n, x in exprs.items()})[0] if exprs else {}


def _aggregate(df: DataFrame, exprs: dict[str, dict[str, Column]]) -> tuple[dict[str, dict], int]:
    out: dict[str, dict] = {}
    n_rows, names = 0, list(exprs)
    per_chunk = max(1, AGGREGATE_WIDTH // 7)
    for i in range(0, max(len(names), 1), per_chunk):
        chunk = names[i : i + per_chunk]
        flat = [e.alias(f"{k}|{key}") for k, n in enumerate(chunk) for key, e in exprs[n].items()]
        row = df.agg(F.count("*").alias("n"), *flat).first().asDict()
        n_rows = row["n"]
        out.update({n: {key: row[f"{k}|{key}"] for key in exprs[n]} for k, n in enumerate(chunk)})
    return out, n_rows


def _frequency_records(df: DataFrame, names: list[str]) -> dict[str, _Found]:
    """Distinct counts, most frequent values as text, and parse counts of every column."""
    if not names:
        return {}
    rows = {r["col"]: r for r in freq.frequency_summary(freq.frequency_table(df, names)).collect()}
    values = {
        names[k]: [(str(freq.cell_value(field_type(df, names[k]), t["i"], t["d"], t["s"], t["m"])), t["cnt"]) for t in r["top"]]
        for k, r in rows.items()
    }
    digests = {n: {v for v, _ in top if v.startswith(freq.DIGEST_MARK)} for n, top in values.items()}
    texts = freq.long_texts(df, {n: keys for n, keys in digests.items() if keys})
    return {
        names[k]: _Found(
            r["n_unique"], tuple((texts.get(v, v), cnt) for v, cnt in values[names[k]]), r["all_integral"],
            r["n_number_text"] or 0, r["n_date_marked"] or 0, r["n_date_parsed"] or 0,
        )
        for k, r in rows.items()
    }


def count_outside(
    df: DataFrame, exprs: dict[str, Column], fences: dict[str, tuple[float, float] | None]
) -> dict[str, int]:
    """Values strictly outside their fences, one pass for all columns."""
    wanted = {n: {"out": _outside(x, *fences[n])} for n, x in exprs.items() if has_spread(fences[n])}
    rows = _aggregate(df, wanted)[0] if wanted else {}
    return {n: rows[n]["out"] if n in rows else 0 for n in exprs}


def _outside(x: Column, low: float, high: float) -> Column:
    return F.count_if((x < F.lit(low)) | (x > F.lit(high)))


def _outliers_and_skewness(
    df: DataFrame, exprs: dict[str, Column], fences: dict[str, tuple[float, float] | None], stats: dict[str, dict]
) -> dict[str, tuple[int, float | None]]:
    """Values strictly outside their fences and the bias-corrected skewness, one pass for all columns.

    The third moment is taken around the known mean, in units of the standard deviation."""
    wanted: dict[str, dict[str, Column]] = {}
    for n, x in exprs.items():
        aggs = {}
        if has_spread(fences[n]):
            aggs["out"] = _outside(x, *fences[n])
        mean, std = finite_or_none(stats[n]["mean"]), finite_or_none(stats[n]["std"])
        if std and mean is not None and math.isfinite(std) and stats[n]["n_number"] > 2:
            z = (x - F.lit(mean)) / F.lit(std)
            aggs["cube"] = F.sum(z * z * z)
        if aggs:
            wanted[n] = aggs
    rows = _aggregate(df, wanted)[0] if wanted else {}
    out = {}
    for n in exprs:
        row, m = rows.get(n, {}), stats[n]["n_number"]
        skewness = None
        if m > 2 and stats[n]["std"] == 0:
            skewness = 0.0
        elif "cube" in row:
            skewness = finite_or_none(row["cube"] * m / ((m - 1) * (m - 2)))
        out[n] = (row.get("out", 0), skewness)
    return out


def logical_bytes(name: str, dtype: T.DataType) -> Column:
    """Bytes of the present cells: text by its length, other types by their fixed width."""
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(dtype, STRING_TYPES + (T.BinaryType,)):
        return F.coalesce(F.sum(F.octet_length(ref(name))), F.lit(0)).cast("bigint")
    if isinstance(dtype, T.ArrayType):
        item = widths.get(type(dtype.elementType), 8)
        return (F.coalesce(F.sum(F.size(ref(name))), F.lit(0)) * item).cast("bigint")
    return (F.count(ref(name)) * widths.get(type(dtype), 8)).cast("bigint")


# -- rules ----------------------------------------------------------------------------------------
def iqr_fences(quartiles: list[float | None]) -> tuple[float, float] | None:
    """Outlier limits; a column without spread keeps its quartiles as limits and has no outliers."""
    q1, _, q3 = quartiles
    if q1 is None:
        return None
    reach = C.FENCE_FACTOR * (q3 - q1)
    return (q1, q3) if reach == 0 else (q1 - reach, q3 + reach)


def has_spread(fences: tuple[float, float] | None) -> bool:
    return fences is not None and fences[0] < fences[1]


def exclusion_reason(c: ColumnProfile) -> str:
    """Why a column should not be used as a feature; empty when it may."""
    if c.missing_ratio > C.MAX_MISSING_RATIO:
        return "too many missing values"
    if c.semantic_type == C.UNSUPPORTED:
        return "unsupported type"
    if c.n_unique <= 1:
        return "single value"
    if c.semantic_type == C.TEXT:
        return "identifier or free text"
    return ""


# -- tables derived from the profile --------------------------------------------------------------
def headline_value() -> Column:
    """Mean to four significant digits, else the most frequent value, else two samples."""
    samples = F.concat_ws(", ", F.slice("sample_values", 1, 2))
    mean = F.when(F.col("semantic_type") == C.NUMERIC, significant(F.col("mean")))
    return F.coalesce(mean, F.col("top_value"), samples)


def overview_table(profile: DataFrame) -> DataFrame:
    return profile.select(
        "ordinal", "name", "semantic_type", "dtype", "n_missing",
        F.round(F.col("missing_ratio") * 100, 2).alias("missing_pct"), "n_unique", headline_value().alias("headline"),
    )


def numeric_describe_table(profile: DataFrame) -> DataFrame:
    stats = ("mean", "std", "minimum", "q1", "median", "q3", "maximum", "skewness")
    return profile.where(F.col("semantic_type") == C.NUMERIC).select(
        "ordinal", "name", *[F.round(c, 4).alias(c) for c in stats], "n_outliers")


def categorical_table(profile: DataFrame, top_n: int = C.AnalysisConfig.categorical_rows) -> DataFrame:
    return (
        profile.where(F.col("semantic_type") == C.CATEGORICAL).orderBy("ordinal").limit(top_n)
        .select("ordinal", "name", "n_unique", "top_value", "top_freq",
                F.round(F.col("missing_ratio") * 100, 2).alias("missing_pct"))
    )


def type_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("semantic_type").agg(
        F.count("*").alias("n_columns"), F.count_if(F.col("n_missing") > 0).alias("n_with_missing"))
