"""Display text: shortened labels and formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten(label: Column, limit: int = 22) -> Column:
    return F.when(F.length(label) > limit, F.concat(F.left(label, F.lit(limit - 1)), F.lit("…"))).otherwise(label)


def significant(x: Column, digits: int = 4) -> Column:
    """x rounded to significant digits, with thousands separators and without trailing zeros; very
    large and very small magnitudes in scientific form."""
    magnitude = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    shift = F.pow(F.lit(10.0), (F.lit(digits - 1) - magnitude).cast("double"))
    rounded = F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * shift) / shift)
    # Rounding can carry into the next power of ten (9999.6 -> 10000).
    carried = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(rounded)) + 1e-12)).cast("int")
    decimals = F.greatest(F.lit(digits - 1) - carried, F.lit(0))
    plain = F.format_number(rounded, digits + 4)
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.format_number(F.round(rounded / F.pow(F.lit(10.0), carried.cast("double")), digits - 1), digits - 1)
    mantissa = F.regexp_replace(F.regexp_replace(mantissa, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(
        mantissa, F.lit("e"), F.when(carried < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(carried).cast("string"), 2, "0"),
    )
    out_of_range = (carried < -4) | (carried >= digits)
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(decimals.isNotNull() & out_of_range, scientific).otherwise(plain)


def cell_text(x: Column) -> Column:
    """A number as a table cell: whole numbers grouped, others to four significant digits, NULL as '-'."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), F.lit("-")).when(whole, F.format_number(x, 0)).otherwise(significant(x))
