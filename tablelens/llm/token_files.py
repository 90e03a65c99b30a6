"""Token ids of all documents as compressed files in ascending document order, and reading them back.

A file set is a Parquet folder with one row per segment: (part, first_token, n_tokens, doc_ids, doc_tokens, ids). `ids`
is the binary segment of `rans`: a frequency table shared by independent interleaved blocks, with checkpoints and a
checksum. Parts are ranges of ascending document ids, `first_token` counts within the part, and a segment ends with the
document that fills it, so that every segment can be read alone, by any task.

Defined cases: a NULL text is empty, an empty document is its end id alone; a NULL document id comes first; rows of
the same id stay in the order of their texts, each a document of its own; other columns are ignored. No documents give
an empty file set and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .token_ids import coder

SEGMENT_TOKENS = 1 << 21
#: Documents encoded at once, and words a worker remembers for it.
SLICE, REMEMBERED = 128, 2_400_000

_SEGMENT = pa.schema([("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("ids", pa.binary())])
_DOC = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])


def segments(docs: DataFrame, tokenizer: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The rows of a file set."""
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), coder(tokenizer, REMEMBERED).encode
        first, held, doc_ids, sizes, n = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((part, first, n, doc_ids, sizes, rans.encode(ids)), _SEGMENT)], schema=_SEGMENT)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    held += (ids, end)
                    doc_ids.append(doc_id)
                    sizes.append(len(ids) // 4 + 1)
                    n += sizes[-1]
                    if n >= segment_tokens:
                        yield close()
                        first, held, doc_ids, sizes, n = first + n, [], [], [], 0
        if n:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
        write, "part int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, ids binary")


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded ids of a file set."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, n, doc_ids, sizes, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = rans.decode(raw).astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                if len(ids) != n or ends[-1] != n:
                    raise ValueError("a segment does not hold its documents")
                data = memoryview(ids.tobytes())
                starts = ends - np.array(sizes)
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), part, np.int32)), pa.array(first + starts), pa.array(doc_ids, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], schema=_DOC)

    # one row per part: at most as many as there are shuffle partitions
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    order = ["part", "first_token", "n_tokens", "doc_ids", "doc_tokens", "ids"]
    found = files.select(*order).mapInArrow(read, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
