"""Records of delimited text whose quoted fields hold line breaks, with as many tasks per file as it has splits.

Whether a line begins inside quotes depends on everything before it. But what a line, or a whole split, does to that is one of
four maps of {outside, inside} to itself, and maps combine in any grouping:

1. Every split is read once for the map of its lines' product (a row per split).
2. The rows of a file are combined in order by window functions: the last map that ignores its entry decides, and the swaps
   after it turn the answer round. So each split is told how it begins, and which split began the record it is in.
3. Every split is read again and cut into its records. What it holds of a record that began before it, and its last record
   if that goes on, are pieces; the pieces of one record are put together by its first split.

A line ends with a line feed or with carriage return and line feed; inside quotes it stays as it is. A quote counts where a field begins with it, and closes where a separator or
the line's end follows. Records without a character are left out; a quote that nothing closes runs to the end of its file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.staging import few_tasks, stage

_ENDS = "file string, start long, opens boolean, stays boolean, text_if_out boolean, text_if_in boolean, begun_if_in boolean"
_PARTS = "file string, owner long, start long, piece int, header boolean, record string"


def decoded_lines(session: SparkSession, path: str | list[str], charset: str) -> DataFrame:
    """(file, start, line): the lines of each split (by its first byte) in their order, empty ones too."""
    line = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    scan = session.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    return few_tasks(scan).select("file", "start", line.alias("line"))


def _with_ends(lines: DataFrame, separator: str) -> DataFrame:
    """Add whether the text after a line is inside quotes: `opens` if the line begins outside, `stays` if it begins inside."""
    mark, closed = re.escape(separator), '(?:[^"]++|"")*+"'
    end = rf"(?={mark}|\r?\z)"

    def open_after(text: Column) -> Column:
        bare = F.regexp_replace(text, f'(^|{mark})"{closed}{end}', "$1")
        return bare.rlike(f'(^|{mark})"')
    rest = F.regexp_replace("line", f'^{closed}{end}', "")
    none = ~F.contains("line", F.lit('"'))
    closes = F.col("line").rlike(f'^{closed}{end}')
    return lines.select("*", (~none & open_after(F.col("line"))).alias("opens"), (none | ~closes | open_after(rest)).alias("stays"))


def _states(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """The state before each line and after the last: the last line whose map is constant decides, swaps after it alternate."""
    n = len(opens)
    if not n:
        return np.array([inside])
    constant, swap = opens == stays, opens & ~stays
    swaps = np.concatenate([[0], np.cumsum(swap)])
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(constant, np.arange(n), -1)]))
    base = np.where(last >= 0, opens[np.maximum(last, 0)], inside)
    since = swaps - np.where(last >= 0, swaps[np.maximum(last, 0) + 1], 0)
    return base ^ (since % 2 == 1)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of the same split, as far as they stand in one batch."""
    for batch in batches:
        if batch.num_rows:
            file, start = pc.run_end_encode(batch.column(0)), pc.run_end_encode(batch.column(1))
            ends = sorted({*file.run_ends.to_pylist(), *start.run_ends.to_pylist()})
            for at, end in zip([0, *ends], ends):
                yield (batch.column(0)[at].as_py(), batch.column(1)[at].as_py()), batch.slice(at, end - at)


def _bools(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _block_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, told = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(["file", "start", "opens", "stays", "text_if_out", "text_if_in", "begun_if_in"], [[v] for v in (*key, *told)])))

    for block, part in _blocks(batches):
        if block != key:
            if key:
                yield row()
            key, told = block, [False, True, False, False, False]
        text, opens, stays = (_bools(part.column(k)) for k in (2, 3, 4))
        out, in_ = (_states(opens, stays, state) for state in told[:2])
        told = [bool(out[-1]), bool(in_[-1]), told[2] or bool((text & ~out[:-1]).any()), told[3] or bool((text & ~in_[:-1]).any()),
                told[4] or bool((~in_[:-1]).any())]
    if key:
        yield row()


def entries(ends: DataFrame) -> DataFrame:
    """(file, start, inside, owner, header): how each split begins, the split where the record that it begins in began, and
    whether the file's first record with a character begins in it."""
    order = Window.partitionBy("file").orderBy("start")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = ends.withColumn("swaps", F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(so_far))
    constant = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("to"), "swaps"))
    last = F.last(constant, ignorenulls=True).over(before)
    swaps = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    rows = rows.withColumn("inside", F.coalesce(last["to"], F.lit(False)) != (swaps % 2 == 1))
    after = F.when(F.col("inside"), F.col("stays")).otherwise(F.col("opens"))
    begun = F.when(after & (~F.col("inside") | F.col("begun_if_in")), F.col("start"))
    text = F.when(F.when(F.col("inside"), F.col("text_if_in")).otherwise(F.col("text_if_out")), F.col("start"))
    return rows.select("file", "start", "inside", F.last(begun, ignorenulls=True).over(before).alias("owner"),
                       (F.min(text).over(Window.partitionBy("file")) == F.col("start")).alias("header"))


def _ended(whole: pa.Array) -> pa.Array:
    """Whole records without their last carriage return; empty ones go."""
    whole = pc.replace_substring_regex(whole, r"\r\z", "")
    return whole.filter(pc.not_equal(pc.binary_length(whole), 0))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (piece is NULL) and pieces (0: begun here, 1: begun before) of each split."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("piece", pa.int32()), ("header", pa.bool_()), ("record", pa.string())])
    key, inside, owner, first, held, begun = None, False, None, False, [], False

    def rows(records: pa.Array, piece: int | None = None) -> pa.RecordBatch:
        nonlocal first
        n = len(records)
        header = np.zeros(n, bool)
        if first and piece != 1 and n:
            header[0], first = True, False
        whose = [owner if piece == 1 else key[1]] * n
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(whose, pa.int64()), pa.array([key[1]] * n, pa.int64()),
                                           pa.array([piece] * n, pa.int32()), pa.array(header), records], schema=schema)

    def joined(lines: list[pa.Array]) -> pa.Array:
        return pa.array(["\n".join(x for part in lines for x in part.to_pylist())], pa.string())

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            last = joined(held)
            if not begun or inside:
                yield rows(last, 0 if begun else 1)
            elif len(last := _ended(last)):
                yield rows(last)

    for block, part in _blocks(batches):
        if block != key:
            if key:
                yield from close()
            key, held, begun = block, [], False
            inside, owner, first = (part.column(k)[0].as_py() for k in (5, 6, 7))
        lines = part.column(2).cast(pa.string())
        states = _states(_bools(part.column(3)), _bools(part.column(4)), inside)
        inside = bool(states[-1])
        starts = np.flatnonzero(~states[:-1])
        if not len(starts):
            held.append(lines)
            continue
        if starts[0]:
            held.append(lines.slice(0, int(starts[0])))
        if held:
            ended = joined(held)
            if not begun:
                yield rows(ended, 1)
            elif len(ended := _ended(ended)):
                yield rows(ended)
        offsets = pa.array(starts.astype(np.int32))
        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n") if len(starts) > 1 else pa.array([], pa.string())
        if len(whole := _ended(whole)):
            yield rows(whole)
        held, begun = [lines.slice(int(starts[-1]))], True
    if key:
        yield from close()


def records(session: SparkSession, path: str | list[str], charset: str, separator: str) -> DataFrame:
    """(file, header, record): every record with a character; `header` marks the first of each file."""
    lines = _with_ends(decoded_lines(session, path, charset), separator)
    text = ~F.col("line").eqNullSafe("") & ~F.col("line").eqNullSafe("\r")
    flags = lines.select("file", "start", text.alias("text"), "opens", "stays")  # no text leaves the JVM here
    told = stage(entries(flags.mapInArrow(_block_ends, _ENDS)), session)
    # one row per split: the bytes of the source by those of a split
    known = lines.join(F.broadcast(told), ["file", "start"])
    parts = stage(known.select("file", "start", "line", "opens", "stays", "inside", "owner", "header").mapInArrow(_parts, _PARTS), session)
    parts = few_tasks(parts)
    pieces = parts.where("piece IS NOT NULL").groupBy("file", "owner").agg(
        F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"))
    whole = pieces.select("file", "header", F.regexp_replace(F.array_join(F.col("p.record"), "\n"), r"\r\z", "").alias("record"))
    # put together once, as the records are read several times
    return parts.where("piece IS NULL").select("file", "header", "record").unionByName(few_tasks(stage(whole, session)))
