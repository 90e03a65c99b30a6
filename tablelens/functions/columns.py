"""Column references and the numeric reading of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in text. Java would also read '3D' and '1f'.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_TEXT = r"(?i)^\s*[+-]?inf(inity)?\s*$"
NUMBER_STARTS = tuple("0123456789+-.,iI\t\n\r")

# Tokens the usual table readers take for a missing cell.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMBER_TYPES = INTEGRAL_TYPES + FLOAT_TYPES + (T.DecimalType,)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)
PROFILED_TYPES = NUMBER_TYPES + TIME_TYPES + STRING_TYPES + (T.BooleanType,)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """A column by its exact name: dots and blanks are part of the name."""
    return F.col(quoted(name))


def text_to_number(text: Column) -> Column:
    """Text to double without thousands separators; anything that is not a number becomes NULL."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    readable = plain.rlike(NUMBER_TEXT) | plain.rlike(INFINITY_TEXT)
    # Most text fails on its first character, before any pattern is tried.
    hopeful = F.left(F.ltrim(text), F.lit(1)).isin(*NUMBER_STARTS)
    return F.when(hopeful & readable, F.trim(plain).try_cast("double"))


def to_number(name: str, dtype: T.DataType) -> Column:
    """The numeric reading of a column, NaN as NULL, whatever its physical type."""
    if isinstance(dtype, STRING_TYPES):
        return text_to_number(ref(name))
    if isinstance(dtype, FLOAT_TYPES):
        return F.nanvl(ref(name).cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, NUMBER_TYPES + (T.BooleanType,)):
        return ref(name).cast("double")
    return F.lit(None).cast("double")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(name, field_type(df, name))


def present(name: str, dtype: T.DataType) -> Column:
    """The column itself, with floating NaN as NULL."""
    if isinstance(dtype, FLOAT_TYPES):
        return F.nanvl(ref(name), F.lit(None).cast(dtype))
    return ref(name)


def finite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) != F.lit(float("inf")))


def normalise_missing(df: DataFrame, tokens: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """NaN and the usual NA tokens become NULL, as the table readers of a notebook would do."""
    out = []
    for f in df.schema.fields:
        c = present(f.name, f.dataType)
        if isinstance(f.dataType, STRING_TYPES):
            c = F.when(~F.trim(c).isin(*tokens), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def finite_or_none(value) -> float | None:
    """NaN (and nothing at all) as None: how undefined statistics are stored."""
    if value is None:
        return None
    value = float(value)
    return None if value != value else value
