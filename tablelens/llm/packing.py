"""Best-fit packing of token pieces into sequences of bounded length.

Bounded-space online best-fit: a fixed number of bins is open at a time, held in a bitset with one bit per amount of
free space. Pieces are taken as they arrive, never sorted by length: each goes into the open bin with the least free
space that still takes it; where none does, a new bin is opened, and the fullest open one closes first if all places
are taken. Pieces are dealt at random to groups of bounded size, packed side by side; the bins still open at the end of
a group arrive like pieces at the next level, until one group holds them all. Nothing but one group is ever in one
task. No more bins are open than half the rows of a group, so every level has fewer rows than the one before.

Defined cases: a NULL text is empty, and an empty document is its end id alone; repeated rows are documents of their
own; longer documents are cut into pieces of the capacity, the last one may be shorter; other columns are ignored.
No documents give no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .token_ids import coding

#: Pieces (or left-over bins) that one task packs, and bins open at a time.
GROUP_ROWS = 20_000
OPEN_BINS = 512
#: Documents encoded at once.
SLICE = 128

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coding(tokenizer) as encode:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    rows = []
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                        ids += end
                        for k, i in enumerate(range(0, len(ids), step)):
                            chunk = ids[i:i + step]
                            rows.append((doc_id, k, i // 4, len(chunk) // 4, zlib.crc32(chunk)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], capacity: int, n_open: int) -> tuple[list[int], list[int], dict[int, int]]:
    """(bin, offset) of each length in turn, and the space used in the bins still open at the end."""
    bins, offsets = [], []
    free_bits, by_free, n_bins, opened = 0, [[] for _ in range(capacity + 1)], 0, 0
    for length in lengths:
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            place = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
            opened -= 1
        else:
            if opened >= n_open:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                opened -= 1
            place, free, n_bins = n_bins, capacity, n_bins + 1
        bins.append(place)
        offsets.append(capacity - free)
        free -= length
        if free:
            by_free[free].append(place)
            free_bits |= 1 << free
            opened += 1
    return bins, offsets, {b: capacity - free for free, group in enumerate(by_free) for b in group}


def _packed(items: DataFrame, n: int, level: int, capacity: int, n_open: int, group_rows: int) -> DataFrame:
    """items: (row, length). Adds (bin, place, left): the bin's id, the offset in it, and the space used if it was
    still open at the end, else NULL."""
    groups = max(1, math.ceil(n / group_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)  # the order of arrival
        bins, offsets, left = best_fit(pdf["length"].tolist(), capacity, n_open)
        first = (int(pdf["group"].iloc[0]) << 32) + (level << 58)
        return pd.DataFrame({
            "row": pdf["row"], "bin": [first + b for b in bins], "place": offsets,
            "left": pd.array([left.get(b) for b in bins], dtype="Int64")})

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(pack, "row long, bin long, place long, left long")


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0,
         open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place."""
    if group_rows < 2 or open_bins < 1:
        raise ValueError("a group holds at least two rows and one open bin")
    open_bins = min(open_bins, group_rows // 2)
    cut = stage(pieces(docs, capacity, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()))
    n = cut.count()
    placed = stage(_packed(cut, n, 0, capacity, open_bins, group_rows))
    level = 1
    while True:
        # one row per bin that is still open: the piece at its start stands for it
        open_rows = placed.where("left IS NOT NULL AND place = 0").select(F.col("bin").alias("row"), F.col("left").alias("length"))
        n_open, groups_before = open_rows.count(), max(1, math.ceil(n / group_rows))
        if groups_before == 1 or n_open == 0:
            break
        above = stage(_packed(open_rows, n_open, level, capacity, open_bins, group_rows)).select(
            F.col("row").alias("bin"), F.col("bin").alias("new_bin"), F.col("place").alias("base"), F.col("left").alias("new_left"))
        # the offset within the new bin; only bins at offset 0 go on standing for it
        placed = stage(placed.join(above, "bin", "left").select(
            "row", F.coalesce("new_bin", "bin").alias("bin"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("place"),
            F.when(F.col("new_bin").isNotNull(), F.col("new_left")).alias("left")))
        n, level = n_open, level + 1
    return cut.join(placed, "row").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
