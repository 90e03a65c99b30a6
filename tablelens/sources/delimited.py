"""Delimited text of unknown encoding and separator.

Encoding, separator, quoting and width are decided by counts over all lines, in parallel; only the header is looked at
by itself."""

from __future__ import annotations

import csv
import io
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import INFINITY_TEXT, MISSING_TOKENS, NUMBER_TEXT, ref
from ..functions.staging import few_tasks, stage
from .records import records
from .tidy import LoadError, unique_names

#: What Java calls the encodings. Its own 'cp949' and 'EUC-KR' lose letters that MS949 has.
JAVA_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "MS949", "euc-kr": "MS949", "latin1": "ISO-8859-1"}
#: What a decoder leaves where bytes mean nothing. UTF-8 is told by its bytes, as a valid text may hold this letter.
UNREADABLE = "\ufffd"
#: Where the fields of a row beyond the header go, joined by the separator.
EXTRA = "_extra"
#: Cannot occur in text, so that a line stays whole.
NO_SEPARATOR = "\u0001"
#: Column types, narrowest first, that fit when every cell is of the kind.
CELL_KINDS = (("whole", "bigint"), ("number", "double"), ("bool", "boolean"))
TRUE_FALSE = ("True", "TRUE", "true", "False", "FALSE", "false")


def charset_session(spark: SparkSession) -> SparkSession:
    """A session of its own for non-UTF-8 text, so that the caller's settings stay as they are."""
    other = spark.newSession()
    other.conf.set("spark.sql.legacy.javaCharsets", "true")
    return other


def read_lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(line): the decoded lines of the source."""
    return few_tasks(
        spark.read.schema("line string").option("encoding", JAVA_NAMES[encoding]).option("sep", NO_SEPARATOR)
        .option("quote", "").option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).option("maxCharsPerColumn", -1).csv(path),
        spark.read.text(path),  # counting asks no decoder
    )


def detect_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """The first encoding that reads the whole text."""
    if few_tasks(spark.read.text(path)).where(~F.is_valid_utf8("value")).isEmpty():
        return C.ENCODINGS[0]
    other = charset_session(spark)
    for encoding in C.ENCODINGS[:-1]:
        if JAVA_NAMES[encoding] != "UTF-8" and read_lines(other, path, encoding).where(F.contains("line", F.lit(UNREADABLE))).isEmpty():
            return encoding
    return C.ENCODINGS[-1]


def layout(lines: DataFrame, header: str, separators: tuple[str, ...] = C.SEPARATORS) -> tuple[str | None, int, int, bool]:
    """(separator, widest row, rows wider than the header, whether quoted fields span lines) from all lines.

    The separator is the one that cuts most lines into as many fields as the header, more than one; None if there is a
    single column. A quote counts where a field begins with it; one inside a field is a letter like any other."""
    widths = {sep: len(_fields(header, sep)) for sep in separators}
    quoted, cells, aggs = F.contains("line", F.lit('"')), [(F.length("line") > 0).alias("full")], []
    for i, sep in enumerate(separators):
        mark = re.escape(sep)
        # lines without a quote, most of a long text, need no pattern
        cells.append(F.when(quoted, F.regexp_replace("line", f'(^|{mark})"(?:[^"]++|"")*+"(?={mark}|$)', "$1")).otherwise(F.col("line")).alias(f"bare{i}"))
    measured = [F.col("full")]
    for i, sep in enumerate(separators):
        bare, size = F.col(f"bare{i}"), F.octet_length if sep.isascii() else F.length
        measured += [(size(bare) - size(F.replace(bare, F.lit(sep), F.lit(""))) + 1).alias(f"width{i}"),
                     (F.contains(bare, F.lit('"')) & bare.rlike(f'(^|{re.escape(sep)})"')).alias(f"open{i}")]
    for i, sep in enumerate(separators):
        width, open_ = F.col(f"width{i}"), F.col(f"open{i}")
        aggs += [F.count_if((width == widths[sep]) & F.col("full")).alias(f"same{i}"), F.max(F.when(~open_, width)).alias(f"most{i}"),
                 F.count_if(~open_ & (width > widths[sep])).alias(f"wider{i}"), F.count_if(open_).alias(f"open{i}")]
    row = lines.select(*cells).select(*measured).agg(*aggs).first()
    usable = [i for i, sep in enumerate(separators) if widths[sep] > 1]
    best = max(usable, key=lambda i: row[f"same{i}"], default=None)
    if best is None or not row[f"same{best}"]:
        comma = separators.index(",") if "," in separators else 0
        return None, 1, 0, row[f"open{comma}"] > 0
    return separators[best], max(row[f"most{best}"] or 0, widths[separators[best]]), row[f"wider{best}"], row[f"open{best}"] > 0


def _fields(header: str, separator: str) -> list[str]:
    return next(csv.reader(io.StringIO(header, newline=""), delimiter=separator), [])


def header_names(header: str, separator: str) -> list[str]:
    """Column names of a header line: blanks are numbered, repeats suffixed, as table readers do."""
    fields = _fields(header, separator)
    names = [f if f.strip() else f"Unnamed: {i}" for i, f in enumerate(fields)]
    return unique_names(names, ".")


def read_delimited(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, str, str, list[str]]:
    """(table, encoding, separator, notes). Column types follow from all cells. Fields beyond the header are kept as text in
    a column of their own. Where quoted fields span lines, every split of a file finds its own records (`records`)."""
    try:
        encoding = detect_encoding(spark, path)
    except AnalysisException as exc:
        raise LoadError(f"cannot find or read {path}: {exc.getCondition() or exc}") from exc
    session = spark if JAVA_NAMES[encoding] == "UTF-8" else charset_session(spark)
    lines = read_lines(session, path, encoding)
    first = lines.where(F.length("line") > 0).first()
    if first is None:
        raise LoadError(f"'{path}' holds no data")
    header = first["line"].lstrip("\ufeff")
    found, widest, n_wider, multi_line = layout(lines, header)
    separator, whole = found or ",", None
    if multi_line:
        whole = records(session, path, JAVA_NAMES[encoding], separator)
        header = whole.where("header").orderBy("file").first()["record"].lstrip("\ufeff")
        _, widest, n_wider, _ = layout(whole.where("NOT header").select(F.col("record").alias("line")), header, (separator,))
    names = header_names(header, separator)
    n_extra = 0 if found is None else max(0, widest - len(names))
    fields = [f"_{i}" for i in range(len(names) + n_extra)]
    schema = ", ".join(f"{f} string" for f in fields)
    options = {"sep": separator, "escape": '"', "maxCharsPerColumn": "-1"}
    if whole is not None:
        raw = whole.where("NOT header").select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    else:
        raw = session.read.schema(schema).options(
            **options, header=True, enforceSchema=True, encoding=JAVA_NAMES[encoding]).csv(path)
    notes = []
    if n_extra:
        tail = F.concat_ws(separator, *[ref(f) for f in fields[len(names):]])
        raw = raw.select(*[ref(f) for f in fields[:len(names)]], F.when(tail != "", tail).alias(f"_{len(names)}"))
        names = unique_names([*names, EXTRA], ".")
        notes.append(f"{n_wider:,} rows have more fields than the header; they are kept in '{names[-1]}'")
    # Text is parsed once into a columnar copy: an analysis reads the table many times, and nothing later
    # depends on the session of the encoding.
    return few_tasks(stage(typed(raw, as_text={f"_{len(names) - 1}"} if n_extra else set()), spark)).toDF(*names), encoding, separator, notes


#: Columns whose cells are looked at in one pass.
CHUNK = 100


def typed(raw: DataFrame, as_text: set[str] = frozenset()) -> DataFrame:
    """Text columns become numbers or booleans where every present cell reads as one. Whole numbers that no 64-bit
    integer holds stay text, as a double would make different ones equal."""
    cells = {c: F.when(~F.trim(ref(c)).isin(*MISSING_TOKENS), F.trim(ref(c))) for c in raw.columns}
    counts: dict[str, int] = {}
    for at in range(0, len(raw.columns), CHUNK):
        aggs = []
        for c in raw.columns[at:at + CHUNK]:
            text = cells[c]
            digits = text.rlike(r"^[+-]?\d+$")
            aggs += [F.count(text).alias(f"{c}|n"),
                     F.count_if(text.rlike(NUMBER_TEXT) | text.rlike(INFINITY_TEXT)).alias(f"{c}|number"),
                     F.count_if(digits & text.try_cast("bigint").isNotNull()).alias(f"{c}|whole"),
                     F.count_if(digits & text.try_cast("bigint").isNull()).alias(f"{c}|long"),
                     F.count_if(text.isin(*TRUE_FALSE)).alias(f"{c}|bool")]
        counts |= raw.agg(*aggs).first().asDict()
    out = []
    for c, text in cells.items():
        n, plain = counts[f"{c}|n"], F.when(text.isNotNull(), ref(c))
        kinds = [t for kind, t in CELL_KINDS if n and counts[f"{c}|{kind}"] == n and not counts[f"{c}|long"] and c not in as_text]
        out.append((text.try_cast(kinds[0]) if kinds else plain).alias(c))
    return raw.select(*out)
