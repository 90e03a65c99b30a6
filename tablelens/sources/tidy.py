"""Load-time tidying: empty rows and columns, column names, left-over index columns, row caps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import field_type, normalise_missing, present, ref

JUNK_PREFIX = "unnamed:"
JUNK_MISSING = 0.9


class LoadError(RuntimeError):
    """A source that cannot be read or holds no data."""


@dataclass
class LoadResult:
    df: DataFrame
    source_name: str
    n_rows: int
    encoding: str | None = None
    separator: str | None = None
    sheet_name: str | None = None
    notes: list[str] = field(default_factory=list)

    def meta(self, spark: SparkSession) -> DataFrame:
        """One row describing the source."""
        return spark.createDataFrame(
            [(self.source_name, self.n_rows, len(self.df.columns), self.encoding, self.separator, self.sheet_name)],
            "source string, n_rows bigint, n_cols int, encoding string, separator string, sheet string")

    def notes_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.notes)), "ord int, note string")

    def meta_dict(self) -> dict[str, str]:
        out = {"source": self.source_name, "size": f"{self.n_rows:,} rows x {len(self.df.columns):,} columns"}
        for k in ("encoding", "separator", "sheet_name"):
            if getattr(self, k):
                out[k.removesuffix("_name")] = getattr(self, k)
        return out


def unique_names(names: list[str], separator: str = "_") -> list[str]:
    """Suffix repeated names with 1, 2, ... until every name is free."""
    out: list[str] = []
    taken = set()
    counts: dict[str, int] = {}
    for name in names:
        candidate = name
        while candidate in taken:
            counts[name] = counts.get(name, 0) + 1
            candidate = f"{name}{separator}{counts[name]}"
        taken.add(candidate)
        out.append(candidate)
    return out


def rename(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def trim_names(df: DataFrame) -> DataFrame:
    """Trimmed column names, made unique."""
    return rename(df, unique_names([c.strip() for c in df.columns]))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without the rows in which every column is missing."""
    return df.where(_any_present(df))


def _any_present(df: DataFrame) -> Column:
    some = F.lit(False)
    for c in df.columns:
        some = some | present(c, field_type(df, c)).isNotNull()
    return some


def column_fill(df: DataFrame) -> tuple[int, int, list[int]]:
    """(rows, rows with any value, values per column) in one aggregate."""
    counts = [F.count(present(c, field_type(df, c))).alias(f"c{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count("*").alias("n"), F.count_if(_any_present(df)).alias("kept"), *counts).first()
    return row["n"], row["kept"], [row[f"c{i}"] for i in range(len(counts))]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    _, _, filled = column_fill(df)
    return df.select(*[ref(c) for c, n in zip(df.columns, filled) if n])


def cap_rows(df: DataFrame, max_rows: int, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; which ones is only determined with an order."""
    ordered = df.orderBy(*[ref(c) for c in order_by]) if order_by else df
    return ordered.limit(max_rows)


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    return cap_rows(df, n, order_by)


def tidy(
    df: DataFrame, source_name: str, *, max_rows: int | None = None, order_by: list[str] | None = None,
    encoding: str | None = None, separator: str | None = None, sheet_name: str | None = None,
    notes: list[str] | None = None, missing_tokens: bool = True,
) -> LoadResult:
    """Tidy a freshly read table. One aggregate decides everything; the rest is a projection."""
    notes = list(notes or [])
    # Positions instead of names until these are known to be unique.
    plain = rename(df, [f"_{i}" for i in range(len(df.columns))])
    if missing_tokens:
        plain = normalise_missing(plain)
    n_rows, kept, filled = column_fill(plain)
    if not kept or not df.columns:
        raise LoadError(f"'{source_name}' holds no data")

    held = [(i, c.strip()) for i, c in enumerate(df.columns) if filled[i]]
    names = unique_names([name for _, name in held])
    keep, junk = [], []
    for (i, _), name in zip(held, names):
        is_junk = name.lower().startswith(JUNK_PREFIX) and 1 - filled[i] / kept > JUNK_MISSING
        (junk if is_junk else keep).append((i, name))
    if junk:
        notes.append(f"dropped {len(junk)} nearly empty columns: {', '.join(n for _, n in junk)}")
    out = drop_empty_rows(plain) if kept < n_rows else plain
    out = out.select(*[F.col(f"_{i}").alias(name) for i, name in keep])
    n_out = kept
    if max_rows and kept > max_rows:
        out, n_out = cap_rows(out, max_rows, order_by), max_rows
        notes.append(f"only the first {max_rows:,} rows are used")
    if (n_out, len(keep)) != (n_rows, len(df.columns)):
        notes.append(f"tidied from {n_rows:,} rows x {len(df.columns):,} columns to {n_out:,} x {len(keep):,}")
    if not keep:
        raise LoadError(f"'{source_name}' holds no data")
    return LoadResult(out, source_name, n_out, encoding, separator, sheet_name, notes)
