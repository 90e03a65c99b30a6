"""Reading dates from text, and the calendar parts used as features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import STRING_TYPES, TIME_TYPES, ref

# A text column may hold dates when most cells contain one of these marks.
DATE_MARKS = r"[-/:]|년|월"

# Accepted layouts, each rewritten to ISO before one cast.
YEAR_FIRST = r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$"
YEAR_MONTH = r"^\s*(\d{4})[-/](\d{1,2})\s*$"
YEAR_LAST = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)(.*)$"
COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})\s*$"
HANGUL = r"^\s*(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일(.*)$"

# Suffix of each calendar feature; Monday is weekday 0.
DATE_PARTS = ("year", "month", "day", "weekday")


def _iso(text: Column, layout: str, order: str) -> Column:
    return F.when(
        text.rlike(layout),
        F.trim(F.regexp_replace(text, layout, order)).try_cast("timestamp_ntz"),
    )


def text_to_datetime(text: Column) -> Column:
    """Mixed-layout date text to timestamp_ntz, NULL where no layout fits. Month comes before day
    unless only the other reading is a date."""
    # Every layout starts with a digit: other text is turned away before any pattern is tried.
    hopeful = F.left(F.ltrim(text), F.lit(1)).isin(*"0123456789\t\n\r")
    return F.when(hopeful, F.coalesce(
        _iso(text, YEAR_FIRST, "$1-$2-$3$4"),
        _iso(text, HANGUL, "$1-$2-$3$4"),
        _iso(text, COMPACT, "$1-$2-$3"),
        _iso(text, YEAR_LAST, "$3-$1-$2$4"),
        _iso(text, YEAR_LAST, "$3-$2-$1$4"),
        _iso(text, YEAR_MONTH, "$1-$2-01"),
    ))


def to_datetime(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, TIME_TYPES):
        return ref(name)
    if isinstance(dtype, STRING_TYPES):
        return text_to_datetime(ref(name))
    return F.lit(None).cast("timestamp_ntz")


def date_parts(value: Column) -> dict[str, Column]:
    parts = (F.year(value), F.month(value), F.dayofmonth(value), F.weekday(value))
    return {suffix: part.cast("double") for suffix, part in zip(DATE_PARTS, parts)}
