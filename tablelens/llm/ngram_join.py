"""N-gram Jaccard join of documents: links between near-equal shingle sets, and their connected groups.

A document's set holds its distinct n-word shingles (as 64-bit hashes; a document with fewer words has its whole
sequence as one). Two documents link when the intersection is at least num/den of the union. Steps:

1. Equal sets become one class, by (digest, size). Everything after that is about classes.
2. Size bands and tiles: two linked sets differ in at most (|x| + |y|) * (den - num) / (den + num) shingles. A band of
   sizes has more slices of the hash range than that, so two linked sets agree in at least one slice in full. A tile
   is (band, slice, hash of the slice's shingles); a class enters the tile of each of its slices, and if it may link
   into the next lower band, that band's tiles as a visitor too. A slice holds several shingles, so neither frequent
   shingles nor shared passages bring unlike documents together, and no order by frequency is needed. Tiles are two
   numbers a row (tile, class) until those with one class are gone; of tiles with the same classes, as near copies have
   by the dozen, one stays.
3. Hashed bitmap signatures: each shingle flips one bit, so differing bits bound the symmetric difference from below
   and the intersection from above. Each class is first compared with the first class of its tiles; pairs that pass are
   decided exactly, and what they link becomes groups. Then, tile by tile, pairs of different groups are bounded by
   sizes and signatures: first the likeliest pair of each group, to join what belongs together, then
   all pairs that are left. Pairs within a group need no comparison for the groups, and no pair that may join two
   groups is left out. A tile is sorted by size and streamed, never held as a whole.
4. Pairs that pass are bounded once more by sketches, signatures with as many bits as the set has shingles, as 512 bits say
   little of a long document. What is left is decided exactly on sorted arrays; links make the final groups. The sets of
   its documents are made from the texts again, in the tasks that read them: ids are looked up in a bitmap of bounded size
   that may let others through, so that neither texts nor sets of documents that no pair names are shuffled or kept.

Defined cases: a NULL text, or one without words, has an empty set and links with nothing; equal texts always link;
a row without an id takes the group of an equal set that has one, else NULL; rows of one id count as linked; other
columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage
from .components import components
from .word_hashes import mix, shingles, words_of

_U = np.uint64
#: Words of a bitmap signature (64 bits each).
SIGNATURE = 8
#: Bits of a filter of ids for each of them, and at most.
FILTER, FILTER_MOST = 64, 1 << 26
#: Rows of a tile compared at once.
TILE_ROWS = 1_024
#: Rounds that join groups by one pair of each of them, before all pairs are looked at.
MERGES = 2


def _sets(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """(batch, first row, sorted distinct shingles of each row from there on)."""
    for batch in batches:
        for part in words_of(batch.column(1)):
            values, bounds = shingles(part, n)
            yield batch, part.first_row, [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, digest, signature, sketch) of every document."""
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, sets in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()),
                pa.array([_sketch(s) for s in sets], pa.binary())], names=["doc_id", "n", "digest", "signature", "sketch"])

    return docs.mapInArrow(scan, "doc_id long, n long, digest long, signature binary, sketch binary")


class Bands:
    """Bands of set sizes, each at least den / num wide, and the number of slices of each."""

    def __init__(self, num: int, den: int):
        bounds = [1]
        while bounds[-1] < 1 << 40:
            low = bounds[-1]
            bounds.append(max(low + 1, low * 3 // 2, -(-low * den // num)))
        self.bounds = np.array(bounds, np.int64)
        slices, spare = [], []
        for low, high in zip(bounds, bounds[1:]):
            differ = (high - 1 + (high - 1) * den // num) * (den - num) // (den + num)
            # slices that are empty by chance say nothing: add as many as a set of the least size may well have
            total, empty = differ + 1, 0
            for _ in range(20):
                mean = total * math.exp(-low / total)
                empty = math.ceil(mean + 4 * math.sqrt(mean))
                total = differ + 1 + empty
            slices.append(total if differ else 0)  # sets that must be equal are one class already
            spare.append(empty)
        self.slices, self.spare = np.array([*slices, 0], np.int64), np.array([*spare, 0], np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, "right") - 1


def _slice_tiles(flat: np.ndarray, size: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(tile, set it is of) for sorted sets laid end to end."""
    keep = bands.slices[band] > 0
    owner = np.repeat(np.arange(len(size)), size)
    flat, owner = flat[keep[owner]], owner[keep[owner]]
    if not len(flat):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    part = ((flat >> _U(32)) * bands.slices[band[owner]].astype(_U)) >> _U(32)
    new = np.ones(len(flat), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    content = np.add.reduceat(mix(flat), first)
    who, where = owner[first], part[first]
    place = mix((band[who].astype(_U) << _U(44)) + where)
    tiles = mix(content ^ place)
    # a set with more empty slices than allowed for also enters the tiles of its empty slices
    full = np.bincount(who, minlength=len(size))
    extra = []
    for i in np.flatnonzero(keep & (bands.slices[band] - full > bands.spare[band])).tolist():
        empty = np.setdiff1d(np.arange(bands.slices[band[i]], dtype=_U), where[who == i])
        extra.append((mix(mix((_U(int(band[i])) << _U(44)) + empty)), np.full(len(empty), i)))
    if extra:
        tiles, who = np.concatenate([tiles, *(x for x, _ in extra)]), np.concatenate([who, *(x for _, x in extra)])
    return tiles, who


def _tiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(tile, class) of every set, the class by its key with the last bit set for visitors; a task reports a set once."""
    bands = Bands(num, den)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, _, sets in _sets(batches, n):
            chosen = {}
            for s in sets:
                key = (len(s), _digest(s))
                if len(s) and key not in seen:
                    seen.add(key)
                    chosen[key] = s
            if not chosen:
                continue
            size, digest = (np.array(x, np.int64) for x in zip(*chosen))
            held = list(chosen.values())
            band = bands.of(size)
            down = np.flatnonzero((band > 0) & (-(-size * num // den) < bands.bounds[band]))
            parts = [(*_slice_tiles(np.concatenate(held), size, band, bands), np.arange(len(size)), False)]
            if len(down):
                parts.append((*_slice_tiles(np.concatenate([held[i] for i in down]), size[down], band[down] - 1, bands), down, True))
            for tiles, who, index, visits in parts:
                keys = digest[index[who]] & ~1 | visits
                yield pa.RecordBatch.from_arrays([pa.array(tiles.view(np.int64)), pa.array(keys)], names=["tile", "class"])

    return docs.mapInArrow(rows, "tile long, class long")


def _shared_tiles(tiles: DataFrame) -> DataFrame:
    """(tile, class): the tiles that hold more than one class, and of those that hold the same classes one."""
    order = Window.partitionBy("tile").orderBy("class")
    rows = tiles.withColumn("before", F.lag("class").over(order)).withColumn("after", F.lead("class").over(order))
    rows = stage(rows.where("before <> class OR after <> class").select("tile", "class").distinct())
    held = rows.groupBy("tile").agg(
        F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"), F.count("*").alias("n"))
    return rows.join(held.groupBy("x", "y", "n").agg(F.min("tile").alias("tile")).select("tile"), "tile", "left_semi")


def _signature(s: np.ndarray) -> bytes:
    """Each shingle flips one bit."""
    flips = np.bincount((s >> _U(40)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _sketch(s: np.ndarray) -> bytes:
    """Each shingle flips one of at least as many bits, a power of two."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    flips = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many bits of two sketches differ, the longer one folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap with the places of all `id`, in whole bytes; with very many ids more of the others pass."""
    bits = min(FILTER_MOST, 1 << max(12, (FILTER * ids.count()).bit_length()))
    place = F.xxhash64("id").bitwiseAND(F.lit(bits - 1))
    words = ids.select(F.shiftright(place, 5).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(31)).cast("int").alias("at"))
    held = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[held["word"].to_numpy()] = held["bits"].to_numpy()
    return out.view(np.uint8)


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the documents in `wanted` (id), and of some others."""
    bitmap = _id_filter(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for whole in batches:
            place = whole.column(2).to_numpy()
            batch = whole.filter(pa.array((bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for _, at, sets in _sets([batch], n):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["node", "shingles"])

    placed = docs.select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(F.lit(8 * len(bitmap) - 1)).alias("place"))
    return placed.mapInArrow(rows, "node long, shingles binary")


def _likely(pairs: DataFrame, looks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the sketches let through."""
    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sizes, left, right = (batch.column(i) for i in range(5))
            differ = [_bits_apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(left, right)]
            sizes = sizes.to_numpy()
            most = (sizes - np.array(differ, np.int64)) // 2  # of the intersection
            mask = pa.array(most * den >= num * (sizes - most))
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    one, two = (looks.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), "x", "y")
    return both.mapInArrow(decide, "a long, b long").distinct()


def _linked(pairs: DataFrame, looks: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""
    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    pairs = stage(_likely(pairs, looks, num, den))
    if pairs.isEmpty():
        return pairs
    one, two = (_full_sets(docs, pairs.select(F.col(end).alias("id")).distinct(), n).select(F.col("node").alias(end), F.col("shingles").alias(name))
                for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long").distinct()


def _may_link(x: dict, y: dict, num: int, den: int) -> np.ndarray:
    """Which pairs the sizes and signatures let through; x and y broadcast against each other."""
    differ = np.bitwise_count(x["signature"] ^ y["signature"]).sum(axis=-1, dtype=np.int64)
    sizes = x["n"] + y["n"]
    most = (sizes - differ) // 2  # of the intersection
    ok = (most * den >= num * (sizes - most)) & (x["group"] != y["group"]) & ~(x["visits"] & y["visits"])
    return ok & (np.minimum(x["n"], y["n"]) * den >= num * np.maximum(x["n"], y["n"]))


def _streamed(rows: DataFrame, visit: Callable, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b), as `visit` gives them, from the rows (tile, n, node, visits, group, signature) sorted by tile and size; `visit` is
    given runs of rows of a batch with their tiles' first rows and yields (a, b)."""
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("tile", "n", "node", "visits", "group")}
            rows["signature"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), _U).reshape(-1, SIGNATURE)
            for a, b in visit(rows, state, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = rows.select("tile", "n", "node", "visits", "group", "signature").repartition("tile").sortWithinPartitions("tile", "n", "node")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _with_first(rows: dict, state: dict, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first of the tile, row) of each row."""
    new = np.ones(len(rows["tile"]), bool)
    new[1:] = rows["tile"][1:] != rows["tile"][:-1]
    if state and state["tile"][0] == rows["tile"][0]:  # the tile goes on from the batch before
        new[0] = False
        rows = {k: np.concatenate([state[k], v]) for k, v in rows.items()}
        new = np.concatenate([[True], new])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    heads = {k: v[first] for k, v in rows.items()}
    state.update({k: v[first[-1]:first[-1] + 1] for k, v in rows.items()})
    ok = _may_link(heads, rows, num, den)
    yield heads["node"][ok], rows["node"][ok]


def _least_of_each(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions of the least value of each group."""
    order = np.lexsort((value, group))
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    return order[new]


def _all_pairs(rows: dict, state: dict, num: int, den: int, *, one_each: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a tile, block by block; blocks of sets too small for what follows are let go. `one_each`: of the pairs
    that a group has in two blocks only the one with the most alike signatures."""
    cuts = (np.flatnonzero(np.diff(rows["tile"])) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(rows["tile"])]):
        if state.get("tile") != rows["tile"][a]:
            state.update(tile=rows["tile"][a], recent=[])
        for at in range(a, b, TILE_ROWS):
            block = {k: v[at:min(b, at + TILE_ROWS)] for k, v in rows.items()}
            least = -(-int(block["n"][0]) * num // den)
            state["recent"] = [r for r in state["recent"] if int(r["n"][-1]) >= least]
            for before in [*state["recent"], block]:
                ok = _may_link({k: v[:, None] for k, v in before.items()}, {k: v[None] for k, v in block.items()}, num, den)
                i, j = np.nonzero(np.triu(ok, 1) if before is block else ok)
                if one_each and len(i):
                    differ = np.bitwise_count(before["signature"][i] ^ block["signature"][j]).sum(axis=1, dtype=np.int64)
                    best = np.concatenate([_least_of_each(g, differ) for g in (before["group"][i], block["group"][j])])
                    i, j = i[best], j[best]
                left, right = before["node"][i], block["node"][j]
                yield np.minimum(left, right), np.maximum(left, right)
            state["recent"].append(block)


def jaccard_groups(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document's set size, and the least id that links reach from it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stage(_scan(docs, n))
    classes = every.where("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"), F.min("sketch").alias("sketch"))

    keyed = classes.where("node IS NOT NULL").select("node", F.col("digest").bitwiseAND(F.lit(~1)).alias("key"))
    rows = _shared_tiles(_tiles(docs, n, num, den)).select(
        "tile", F.col("class").bitwiseAND(F.lit(~1)).alias("key"), (F.col("class").bitwiseAND(F.lit(1)) == 1).alias("visits"))
    shared = stage(rows.join(keyed, "key").select("tile", "node", "visits"))
    looks = stage(classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "signature", "sketch"))

    # each class against the first one of its tiles
    first = _streamed(shared.join(looks.drop("sketch"), "node").withColumn("group", F.col("node")), _with_first, num, den)
    first = first.groupBy("b").agg(F.min("a").alias("a"))  # one for each
    first = stage(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stage(_linked(first, looks, docs, n, num, den))

    # what may join two groups: the likeliest pair of each group, as long as that finds links, then all pairs
    tried, groups, merges = first, stage(components(links)), MERGES
    while True:
        grouped = shared.join(groups, "node", "left").select("tile", "node", "visits", F.coalesce("component", "node").alias("group"))
        several = grouped.groupBy("tile").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g <> h").select("tile")
        open_rows = grouped.join(several, "tile").join(looks.drop("sketch"), "node")
        visit = partial(_all_pairs, one_each=merges > 0)
        pairs = stage(_streamed(open_rows, visit, num, den).join(tried, ["a", "b"], "left_anti"))
        found = stage(_linked(pairs, looks, docs, n, num, den))
        new = not found.isEmpty()
        if new:
            links = links.unionByName(found)
            groups = stage(components(links))
        if not merges:
            break
        tried, merges = tried.unionByName(pairs), merges - 1 if new else 0

    copies = every.join(classes, ["n", "digest"], "left").select("doc_id", "n", "node")
    out = copies.join(groups, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
