"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A document leaks an item when the best local alignment of their words (a match counts 1, a mismatch and a gap -1)
reaches `least` of the item's words, and half of `least_words` at any rate: so copies with edits, insertions and lost ends
count, and common words do not. Every n-word sequence of a test item is a seed. An alignment with score s has at most m - s
errors between its m matches, so m - s + 1 runs of matches: whole two-word seeds lie in it at s - 1 places of the item at
least. A first scan counts the documents that hold each seed. An item of N places keeps the N - s + 2 of the least counts
(its rare seeds), s being the least score that counts: any alignment that counts holds one of these, whatever the counts.
A second scan finds the rare seeds in the documents and makes a window around each, as wide as an alignment through it
can be; windows with fewer than s - 1 of the item's seeds are dropped, those of one item that overlap are joined, and each
is aligned with the item's words. So the result is that of aligning every item with every document. Seeds of more than two
words are allowed (`n`); an item to which they promise nothing keeps them all, and that alone is no guarantee.

The items are taken in blocks of bounded size, each with its own scans, so what is sent to all tasks is bounded
whatever the number of items; the documents are never shuffled, and all work on a document is done where it is read.

Defined cases: a NULL or empty text leaks nothing; an item that is NULL or has fewer than `least_words` words can't be
told from common words and is never found; repeated documents give a row each; items of equal texts are each found; a
NULL id is carried on; other columns are ignored. No documents, or no items, give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_hashes import Words, mix, shingles, words_of

_U = np.uint64
#: Code points of the items of one block, sent to all tasks.
BLOCK_CHARS = 8_000_000
#: Alignments done side by side, and the words of their windows with what pads them.
AT_ONCE, WORDS_AT_ONCE = 512, 1 << 18
_FILTER_BITS = 20


class Items:
    """A block of test items: their words as hashes, and their seeds."""

    def __init__(self, ids: list[int], texts: list[str], n: int, least_words: int, least: float = 0.5):
        self.n, self.ids, self.words = n, [], []
        seeds, owners, places = [], [], []
        for part in words_of(pa.array(texts, pa.large_string())):
            for r in range(part.rows):
                h = part.hashes[part.bounds[r]:part.bounds[r + 1]]
                if len(h) < max(n, least_words):
                    continue
                self.ids.append(ids[part.first_row + r])
                self.words.append(h)
            values, bounds = shingles(part, n)
            for r in range(part.rows):
                if part.bounds[r + 1] - part.bounds[r] >= max(n, least_words):
                    mine = values[bounds[r]:bounds[r + 1]]
                    seeds.append(mine)
                    owners.append(np.full(len(mine), len(owners)))
                    places.append(np.arange(len(mine)))
        self._set(*(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((seeds, _U), (owners, np.int64), (places, np.int64))))
        size = np.array([len(w) for w in self.words], np.int64)
        self.needed = np.maximum(least * size, least_words / 2)
        score = np.ceil(self.needed).astype(np.int64)
        #: Seeds that an alignment which counts holds: m - (n - 1) * (m - score + 1), the least over m from score to size.
        self.least_hits = np.minimum(score - (n - 1), size - (n - 1) * (size - score + 1))
        self.pad = np.maximum(size - score, size // 2) + 4  # an alignment that counts has no more than size - score insertions
        self.pairs = np.unique(self._pair(self.seeds, self.owners))

    @staticmethod
    def _pair(seeds: np.ndarray, owners: np.ndarray) -> np.ndarray:
        return mix(seeds ^ mix(owners.astype(_U) + _U(1)))

    def _set(self, seeds: np.ndarray, owners: np.ndarray, places: np.ndarray) -> None:
        order = np.lexsort((places, owners, seeds))
        self.seeds, self.owners, self.places = seeds[order], owners[order], places[order]
        self.distinct, self.first = np.unique(self.seeds, return_index=True)
        self.upto = np.append(self.first[1:], len(self.seeds))
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.distinct >> _U(64 - _FILTER_BITS)] = True

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Keep so many seeds of each item, those of the least document counts, that no alignment that counts can do without."""
        each = np.array([counts.get(s, 0) for s in self.seeds.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.places, each, self.owners))
        owner = self.owners[order]
        size = np.bincount(owner, minlength=len(self.words))
        rank = np.arange(len(order)) - (np.cumsum(size) - size)[owner]
        keep = order[rank <= (size - np.maximum(self.least_hits, 1))[owner]]
        self._set(self.seeds[keep], self.owners[keep], self.places[keep])

    def find(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word within the row, number of the distinct seed) of every seed among the shingles of the texts."""
        at = np.flatnonzero(self.maybe[values >> _U(64 - _FILTER_BITS)])
        where = np.minimum(np.searchsorted(self.distinct, values[at]), max(0, len(self.distinct) - 1))
        hit = self.distinct[where] == values[at] if len(self.distinct) else np.zeros(0, bool)
        at, where = at[hit], where[hit]
        row = np.searchsorted(bounds, at, "right") - 1
        return row, at - bounds[row], where

    def enough(self, values: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether the shingles from `start` to `stop` have as many seeds of the item as an alignment that counts."""
        out = np.ones(len(item), bool)
        for some in np.split(np.arange(len(item)), np.arange(AT_ONCE, len(item), AT_ONCE)):
            size = np.maximum(stop[some] - start[some], 0)
            of = np.repeat(np.arange(len(some)), size)
            place = np.arange(len(of)) + (start[some] - (np.cumsum(size) - size))[of]
            pair = self._pair(values[place], item[some][of])
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            out[some] = np.bincount(of[self.pairs[where] == pair], minlength=len(some)) >= self.least_hits[item[some]]
        return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of it in the window, exclusive) of each pair."""
    height, width = max(map(len, items)), max(map(len, windows))
    left = np.zeros((len(items), height), _U)
    right = np.ones((len(items), width), _U)  # what pads one side never equals what pads the other
    used = np.zeros((len(items), height), bool)
    for i, (a, b) in enumerate(zip(items, windows)):
        left[i, :len(a)], right[i, :len(b)], used[i, :len(a)] = a, b, True
    slope = np.arange(width, dtype=np.int32)
    row = np.zeros((len(items), width), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(height):
        equal = (left[:, i, None] == right) & used[:, i, None]
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        new = np.maximum(np.maximum(diagonal + np.where(equal, 1, -1), row - 1), 0).astype(np.int32)
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the window
        peak = row.argmax(axis=1)
        score = row[np.arange(len(items)), peak]
        better = score > best
        best[better], end[better] = score[better], peak[better] + 1
    return best, end


def _windows(items: Items, words: Words) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, from, to) in words: what is around the seeds of one item in one text, joined where it overlaps."""
    values, bounds = shingles(words, items.n)
    rows, places, seed = items.find(values, bounds)
    copies = items.upto[seed] - items.first[seed]
    which = np.repeat(items.first[seed], copies) + np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    row, item = np.repeat(rows, copies), items.owners[which]
    start = np.repeat(places, copies) - items.places[which]
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    new = np.ones(len(order), bool)  # the same window once
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    row, item, start = row[new], item[new], start[new]
    size = np.array([len(w) for w in items.words], np.int64)[item]
    a = np.maximum(0, start - items.pad[item])
    b = np.minimum(np.diff(words.bounds)[row], start + size + items.pad[item])
    good = items.enough(values, item, bounds[row] + a, np.minimum(bounds[row] + b - items.n + 1, bounds[row + 1]))
    open_ = None
    for r, i, a, b in zip(row[good].tolist(), item[good].tolist(), a[good].tolist(), b[good].tolist()):
        if open_ is not None and open_[:2] == (r, i) and a <= open_[3]:
            open_ = (r, i, open_[2], max(b, open_[3]))
        else:
            if open_ is not None:
                yield open_
            open_ = (r, i, a, b)
    if open_ is not None:
        yield open_


def leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = 2, least: float = 0.5, least_words: int = 8,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each item a document leaks, with its best alignment."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_chars))
    found = [_leaks_of_block(spark, docs, usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b), n, least, least_words)
             for b in range(n_blocks)]
    return reduce(DataFrame.unionByName, found)


def _leaks_of_block(spark, docs: DataFrame, block: DataFrame, n: int, least: float, least_words: int) -> DataFrame:
    rows = block.orderBy("item_id", "text").collect()
    items = Items([r.item_id for r in rows], [r.text for r in rows], n, least_words, least)
    first = spark.sparkContext.broadcast(items)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = first.value
        total = np.zeros(len(items.distinct), np.int64)
        for batch in batches:
            for words in words_of(batch.column(0)):
                row, _, seed = items.find(*shingles(words, items.n))
                pairs = np.unique(row * max(1, len(total)) + seed)
                total += np.bincount(pairs % max(1, len(total)), minlength=len(total)) if len(pairs) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.distinct[some].view(np.int64)), pa.array(total[some])], names=["seed", "docs"])

    counted = docs.select("text").mapInArrow(count, "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs"))
    items.keep_rare({r.seed: r.docs for r in counted.collect()})  # one row per seed of the block at most
    second = spark.sparkContext.broadcast(items)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = second.value
        for batch in batches:
            ids = batch.column(0)
            for words in words_of(batch.column(1)):
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                todo: list[tuple[int, int, int, int]] = []

                def settle() -> None:
                    texts = [words.hashes[words.bounds[r] + a:words.bounds[r] + b] for r, _, a, b in todo]
                    own = [items.words[i] for _, i, _, _ in todo]
                    score, end = align(own, texts)
                    good = [k for k in range(len(todo)) if score[k] >= items.needed[todo[k][1]]]
                    if good:  # where it begins: the same, read backwards from its end
                        _, back = align([own[k][::-1] for k in good], [texts[k][:end[k]][::-1] for k in good])
                    for k, length in zip(good, back.tolist() if good else ()):
                        r, i, a, _ = todo[k]
                        new = (float(score[k]) / len(own[k]), a + int(end[k]) - length, a + int(end[k]))
                        if (r, i) not in best or new[0] > best[r, i][0]:
                            best[r, i] = new
                    todo.clear()

                widest = 0
                for window in _windows(items, words):
                    widest = max(widest, window[3] - window[2])
                    if todo and (len(todo) >= AT_ONCE or (len(todo) + 1) * widest > WORDS_AT_ONCE):
                        settle()
                        widest = window[3] - window[2]
                    todo.append(window)
                if todo:
                    settle()
                keys = list(best)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([words.first_row + r for r, _ in keys], pa.int64())), pa.array([items.ids[i] for _, i in keys], pa.int64()),
                    pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.int64()),
                    pa.array([best[k][2] for k in keys], pa.int64())], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.mapInArrow(find, "doc_id long, item_id long, score double, start_word long, end_word long")
