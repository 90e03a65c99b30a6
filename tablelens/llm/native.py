"""Column helpers shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text; none of a NULL text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), lambda w: w != "")


def upto(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))
