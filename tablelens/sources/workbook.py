"""Workbooks (xlsx, xlsm) read in parallel, one file per task step: rows leave as arrays of text."""

from __future__ import annotations

import datetime
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stage
from .delimited import typed
from .tidy import LoadError, unique_names

BATCH_ROWS = 5_000
ROWS = "path string, row_no int, names array<string>, cells array<string>"

# Names inside the file format, and its built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
DAY_ZERO = datetime.datetime(1899, 12, 30)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of every sheet in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        part = targets[s.get(REL)]
        out.append((s.get("name"), part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
    return out


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt")
        if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)
    }
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else [])
            if int(x.get("numFmtId", "0")) in DATE_FORMATS | custom}


def _column_no(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - ord("A") + 1
    return n - 1


def _cell(c, shared: list[str], dates: set[int]) -> str | None:
    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind == "e":
        return None
    if kind == "n" and int(c.get("s", "0")) in dates:
        moment = DAY_ZERO + datetime.timedelta(days=float(v.text))
        return str(moment.replace(microsecond=0))
    return v.text


def _rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[int]) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet, streamed."""
    number = 0
    with book.open(part) as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag != f"{MAIN}row":
                continue
            number = int(element.get("r", number + 1))
            cells: list[str | None] = []
            for i, c in enumerate(element.iter(f"{MAIN}c")):
                at = _column_no(c.get("r")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _cell(c, shared, dates)
            yield number, cells
            element.clear()


def _parser(sheet_name: str | None):
    """Parse one sheet of every workbook: its first row names the columns, each further row leaves with
    those names. Without a sheet name the first sheet is read; workbooks without the sheet are skipped."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    parts = [part for i, (name, part) in enumerate(_sheets(book))
                             if (name == sheet_name if sheet_name else i == 0)]
                    if not parts:
                        continue
                    rows = _rows(book, parts[0], _shared_strings(book), _date_styles(book))
                    _, header = next(rows, (0, []))
                    names = unique_names([(c or "").strip() or f"Unnamed: {i}" for i, c in enumerate(header)], ".")
                    while chunk := list(itertools.islice(rows, BATCH_ROWS)):
                        yield pd.DataFrame([(path, no, names, cells) for no, cells in chunk],
                                           columns=["path", "row_no", "names", "cells"])

    return parse


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                names = [name for name, _ in _sheets(book)]
            yield pd.DataFrame({"path": path, "sheet_no": range(len(names)), "sheet": names})


def _files(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as exc:
        raise LoadError(f"cannot find or read {path}: {exc.getCondition() or exc}") from exc


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet_no, sheet) of every workbook under the path."""
    return _files(spark, path).mapInPandas(_list, "path string, sheet_no int, sheet string")


def read_workbook(spark: SparkSession, path: str, sheet_name: str | None = None) -> tuple[DataFrame, str, int]:
    """(table, sheet, sheets in the first workbook): the named sheet, else the first one, of all workbooks
    under the path. Columns are matched by the names in each sheet's first row."""
    first = list_sheets(spark, path).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("sheet_no", "sheet"))).alias("sheets")).orderBy("path").first()
    if first is None:
        raise LoadError(f"'{path}' holds no sheet")
    names = [s["sheet"] for s in first["sheets"]]
    if sheet_name and sheet_name not in names:
        raise LoadError(f"no sheet '{sheet_name}'; there are {', '.join(names)}")
    # Unpacked once; column names and types are then read from the copy.
    rows = stage(_files(spark, path).mapInPandas(_parser(sheet_name), ROWS))
    columns = [
        r["name"] for r in rows.select("path", "names").distinct().select("path", F.posexplode("names").alias("pos", "name"))
        .groupBy("name").agg(F.min(F.struct("path", "pos")).alias("at")).orderBy("at").collect()]
    if not columns:
        raise LoadError(f"'{path}' holds no data")
    at = [F.array_position("names", c).cast("int") for c in columns]
    raw = rows.select(*[F.when(p > 0, F.try_element_at("cells", p)).alias(f"_{i}") for i, p in enumerate(at)])
    return stage(typed(raw)).toDF(*columns), sheet_name or names[0], len(names)
