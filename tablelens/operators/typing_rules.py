"""Semantic column types and the task a target asks for, decided from whole-table counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import (
    NUMBER_TYPES, PROFILED_TYPES, STRING_TYPES, TIME_TYPES, field_type, finite, number_of, present, ref,
)
from ..functions.dates import DATE_MARKS, text_to_datetime


@dataclass(frozen=True)
class TypeEvidence:
    """What the type rules look at for one column."""

    dtype: T.DataType
    n_present: int
    n_unique: int = 0
    all_integral: bool = False
    n_number: int = 0
    more_numbers_than_codes: bool = False
    n_date_marked: int = 0
    n_date_parsed: int = 0


def decide_type(e: TypeEvidence) -> str:
    """The semantic type; the first rule that applies wins."""
    if isinstance(e.dtype, TIME_TYPES):
        return C.DATETIME
    if isinstance(e.dtype, T.BooleanType):
        return C.CATEGORICAL
    if not isinstance(e.dtype, PROFILED_TYPES):
        return C.UNSUPPORTED
    if e.n_present == 0:
        return C.TEXT
    if isinstance(e.dtype, NUMBER_TYPES):
        coded = e.n_unique <= C.CATEGORICAL_MAX_DISTINCT and e.all_integral
        return C.CATEGORICAL if coded else C.NUMERIC
    if e.n_number / e.n_present > C.NUMERIC_TEXT_SHARE:
        return C.NUMERIC if e.more_numbers_than_codes else C.CATEGORICAL
    if (e.n_date_marked / e.n_present > C.DATE_MARK_SHARE
            and e.n_date_parsed / e.n_present > C.DATE_PARSE_SHARE):
        return C.DATETIME
    if e.n_unique / e.n_present >= C.IDENTIFIER_RATIO and e.n_unique > C.CATEGORICAL_MAX_DISTINCT:
        return C.TEXT
    return C.CATEGORICAL


def decide_task(e: TypeEvidence | None) -> str:
    """Regression, classification, or plain exploration when there is no usable target."""
    if e is None or e.n_present == 0:
        return C.EDA
    if isinstance(e.dtype, T.BooleanType):
        return C.CLASSIFICATION
    if isinstance(e.dtype, NUMBER_TYPES):
        coded = e.n_unique <= C.MAX_TARGET_CLASSES and e.all_integral
        return C.CLASSIFICATION if e.n_unique <= 2 or coded else C.REGRESSION
    numeric_text = e.n_number / e.n_present > C.NUMERIC_TEXT_SHARE and e.more_numbers_than_codes
    return C.REGRESSION if numeric_text else C.CLASSIFICATION


def evidence_exprs(df: DataFrame, name: str) -> dict[str, F.Column]:
    """Aggregates behind TypeEvidence, apart from the distinct counts."""
    dtype = field_type(df, name)
    c = present(name, dtype)
    out = {"n_present": F.count(c)}
    if isinstance(dtype, NUMBER_TYPES):
        x = number_of(df, name)
        fin = finite(x)
        out["all_integral"] = F.coalesce(F.bool_and(F.when(fin, x % 1 == 0)), F.lit(False))
        out["n_number"] = F.count(x)
    elif isinstance(dtype, STRING_TYPES):
        out["n_number"] = F.count(number_of(df, name))
        out["n_date_marked"] = F.count_if(ref(name).rlike(DATE_MARKS))
        out["n_date_parsed"] = F.count(text_to_datetime(ref(name)))
    return out


def has_more_numbers_than(df: DataFrame, name: str, limit: int) -> bool:
    """Whether a column holds more than `limit` different numbers; stops as soon as that is known."""
    x = number_of(df, name)
    return df.select(x.alias("x")).where(F.col("x").isNotNull()).distinct().limit(limit + 1).count() > limit


def distinct_values(df: DataFrame, name: str, limit: int) -> int:
    """Distinct present values of a column, counted up to limit + 1."""
    c = present(name, field_type(df, name))
    return df.select(c.alias("x")).where(F.col("x").isNotNull()).distinct().limit(limit + 1).count()


def gather_evidence(df: DataFrame, name: str) -> TypeEvidence:
    """Evidence for one column. The distinct count is exact up to the largest threshold in use, unless
    the identifier ratio needs all of it."""
    dtype = field_type(df, name)
    exprs = evidence_exprs(df, name)
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict()
    more = False
    if isinstance(dtype, STRING_TYPES) and row["n_present"] and row["n_number"] / row["n_present"] > C.NUMERIC_TEXT_SHARE:
        more = has_more_numbers_than(df, name, C.CATEGORICAL_MAX_DISTINCT)
    if isinstance(dtype, STRING_TYPES):
        n_unique = df.select(ref(name).alias("x")).where(F.col("x").isNotNull()).distinct().count()
    else:
        n_unique = distinct_values(df, name, C.CATEGORICAL_MAX_DISTINCT)
    return TypeEvidence(dtype=dtype, n_unique=n_unique, more_numbers_than_codes=more, **row)


def infer_column_type(df: DataFrame, name: str) -> str:
    return decide_type(gather_evidence(df, name))


def suggest_task_type(df: DataFrame, target: str | None) -> str:
    """What the target asks for. Distinct values are only counted up to the class limit."""
    if not target or target not in df.columns:
        return C.EDA
    dtype = field_type(df, target)
    exprs = evidence_exprs(df, target)
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict()
    more = False
    if isinstance(dtype, STRING_TYPES) and row["n_present"] and row["n_number"] / row["n_present"] > C.NUMERIC_TEXT_SHARE:
        more = has_more_numbers_than(df, target, C.MAX_TARGET_CLASSES)
    return decide_task(TypeEvidence(
        dtype=dtype, n_unique=distinct_values(df, target, C.MAX_TARGET_CLASSES), more_numbers_than_codes=more, **row))
