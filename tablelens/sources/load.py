"""Reading a path into a tidy table."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_delimited
from .tidy import LoadError, LoadResult, tidy
from .workbook import read_workbook

TEXT_SUFFIXES = (".csv", ".txt", ".tsv")
WORKBOOK_SUFFIXES = (".xlsx", ".xlsm")
TABLE = ".table"
NATIVE_FORMATS = {".parquet": "parquet", ".json": "json", ".orc": "orc"}


def load_table(
    spark: SparkSession, path: str, *, format: str | None = None, sheet_name: str | None = None, max_rows: int | None = None,
    order_by: list[str] | None = None,
) -> LoadResult:
    """Read delimited text, a workbook, a Spark-native format or a table of the catalog, and tidy it.

    `path` is a file, a folder, a glob or a table name. The format is that of the suffix; a folder or glob without one has that
    of its files. `format` says it outright: csv, xlsx, parquet, json, orc or table. Text files with different headers
    are matched by column names."""
    name = os.path.basename(path.rstrip("/"))
    suffix = f".{format.lower()}" if format else os.path.splitext(name)[1].lower()
    options = {"max_rows": max_rows, "order_by": order_by}
    known = (*TEXT_SUFFIXES, *WORKBOOK_SUFFIXES, *NATIVE_FORMATS)
    if suffix == TABLE or (suffix not in known and not format and _is_table(spark, path)):
        return tidy(_table(spark, path), name, missing_tokens=False, **options)
    if suffix not in known and not format:
        suffix = _suffix_inside(spark, path) or suffix
    if suffix in TEXT_SUFFIXES:
        df, encoding, separator, notes = _text(spark, path)
        return tidy(df, name, encoding=encoding, separator=separator, notes=notes, **options)
    if suffix in WORKBOOK_SUFFIXES:
        df, sheet, n_sheets = read_workbook(spark, path, sheet_name)
        notes = [f"sheet '{sheet}' of {n_sheets} is used"] if n_sheets > 1 else []
        return tidy(df, name, sheet_name=sheet, notes=notes, **options)
    if suffix in NATIVE_FORMATS:
        return tidy(_native(spark, path, NATIVE_FORMATS[suffix]), name, missing_tokens=False, **options)
    raise LoadError(f"unsupported format '{suffix or 'without suffix'}' (supported: {', '.join(sorted((*known, TABLE)))})")


def _is_table(spark: SparkSession, name: str) -> bool:
    return bool(re.fullmatch(r"[\w`]+(\.[\w`]+){0,2}", name)) and spark.catalog.tableExists(name)


def _table(spark: SparkSession, name: str) -> DataFrame:
    if not _is_table(spark, name):
        raise LoadError(f"no table '{name}'")
    return spark.table(name)


def _suffix_inside(spark: SparkSession, path: str) -> str | None:
    """The one suffix of the files that a folder or glob stands for; None if they have several or none."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    names = set()
    for found in system.globStatus(pattern) or []:
        inside = system.listStatus(found.getPath()) if found.isDirectory() else [found]
        names |= {f.getPath().getName() for f in inside if f.isFile()}
    suffixes = {os.path.splitext(n.removesuffix(".gz"))[1].lower() for n in names if n[0] not in "._"}
    return suffixes.pop() if len(suffixes) == 1 else None


def _text(spark: SparkSession, path: str) -> tuple[DataFrame, str, str, list[str]]:
    """Files with the same header are read together; those with another are matched by column names."""
    try:
        text = spark.read.text(path)
        if len(text.inputFiles()) == 1:
            return read_delimited(spark, path)
        lines = text.where("_metadata.file_block_start = 0").select(
            "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"))
        heads = lines.where(F.length("value") > 0).groupBy("file").agg(F.min_by("value", "i").alias("head"))
        groups = [sorted(r["files"]) for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()]
    except AnalysisException as exc:
        raise LoadError(f"cannot find or read {path}: {exc.getCondition() or exc}") from exc
    if len(groups) <= 1:
        return read_delimited(spark, path)
    parts = [read_delimited(spark, files) for files in sorted(groups)]
    notes = [f"files with {len(parts)} different headers are matched by column names", *(n for part in parts for n in part[3])]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [part[0] for part in parts])
    return whole, parts[0][1], parts[0][2], notes


def _native(spark: SparkSession, path: str, source: str) -> DataFrame:
    try:
        return spark.read.format(source).load(path)
    except AnalysisException as exc:
        raise LoadError(f"cannot find or read {path}: {exc.getCondition() or exc}") from exc
