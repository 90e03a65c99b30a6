"""Align the tokens of two tokenizers over the same bytes, and count which of their ids go together.

Each tokenizer has a token-byte incidence matrix in hand-built compressed rows (`csr`). Gustavson's row products A x B' give
the overlap links (tokens that share bytes, and how many). Offsets where tokens of both end cut the bytes into groups; the
products of the id-by-group matrices give the shared-group links: how often an id of A and one of B stand in one group.
A group of many tokens costs its different ids only, as their numbers are multiplied.

Tokens of both never run across a space that comes after a character that is no white space (A splits there before it
merges; no piece of B has a space after another character, which is checked when B is loaded). So a text is cut at such
spaces into chunks, and each chunk is a whole number of groups. Different chunks are tokenized and aligned once per worker;
the documents of a slice (`SLICE_BYTES` of text, or one longer document) are then the product of a document-by-chunk and a
chunk-by-pair matrix.

A slice is one row: its documents, its different id pairs, and the document-by-pair matrix. Pairs are counted over all
slices by Spark (in how many documents a pair is linked), every slice asks for the counts of its own pairs by a join, and
multiplies them in. Nothing is broadcast or sent to the driver, and no task holds more than a slice.

Defined cases: texts that are NULL, empty or changed by a tokenizer (the joined bytes of its tokens are not the space and the
text) have no tokens, zeros and an empty digest. Names of special tokens inside texts are plain text. Repeated rows are
documents of their own; NULL ids stay. Other columns are ignored. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..functions.staging import stage
from .csr import Csr, gather, product, spread
from .token_ids import BYTE_LETTERS

#: UTF-8 bytes of texts in a slice; chunks a worker remembers; chunks aligned at once.
SLICE_BYTES, REMEMBERED, AT_ONCE = 2 << 20, 200_000, 20_000
SPACE = "▁"

_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_SLICE = pa.schema([("slice", pa.int64()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _FIGURES],
                    ("digest", pa.list_(pa.string())), ("pair", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())),
                    ("starts", pa.binary()), ("columns", pa.binary()), ("values", pa.binary())])
_SLICE_DDL = ("slice long, doc_id array<long>, " + "".join(f"{c} array<long>, " for c in _FIGURES) +
              "digest array<string>, pair array<long>, n_docs array<long>, starts binary, columns binary, values binary")
_DOC = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*_FIGURES, "n_best", "count_sum")], ("groups_sha256", pa.string())])
_DOC_DDL = "doc_id long, " + "".join(f"{c} long, " for c in (*_FIGURES, "n_best", "count_sum")) + "groups_sha256 string"
_GROUP = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])
_GROUP_DDL = "doc_id long, group long, start long, length long, a_ids array<int>, b_ids array<int>"

_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(a: str, b: str) -> "Aligner":
    """The aligner of two tokenizer files, one per worker process."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def is_open(piece: str) -> bool:
    """Whether the space after a piece is no place to cut."""
    return not piece or piece[-1].isspace()


class Numbers(dict):
    """Numbers of chunks; one that is missing gets the next."""

    def __init__(self, owner: "Aligner"):
        self.owner = owner

    def __missing__(self, chunk: str) -> int:
        new = self.owner.new
        if self is self.owner.known and is_open(chunk):
            number = -1
        else:
            number = len(self.owner.groups) + len(new)
            new.append(chunk)
        self[chunk] = number
        return number


class Aligner:
    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(public_tokenizers.path(a))
        self.a.encode_special_tokens = True
        letters = {c: byte for byte, c in BYTE_LETTERS.items()} | {chr(c): c for c in range(256) if c not in BYTE_LETTERS}
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda e: e[1])
        self.a_bytes = [bytes(letters[c] for c in entry) for entry, _ in entries]
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError(f"{b} has pieces that run across spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.width = len(pieces)  # a pair of ids is a * width + b
        self._forget()

    def _forget(self) -> None:
        self.new: list[str] = []  # chunks with a number that are not aligned yet
        self.known = Numbers(self)  # pieces between spaces; -1: not a chunk by itself
        self.ends = Numbers(self)  # chunks of several pieces, or at the end of a text
        self.groups: list[str] = []
        self.uses = np.zeros(0, np.int64)
        self.figures = [np.zeros((0, len(_FIGURES) + 1), np.int64)]  # and whether the bytes agree
        self.pairs = [Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def _forget_rare(self) -> None:
        """Keep the half that is used most, and what was used before this time."""
        figures, pairs = self.memory()
        keep = np.sort(np.argsort(self.uses, kind="stable")[len(self.groups) // 2:])
        keep = keep[self.uses[keep] > 1]
        number = np.full(len(self.groups), -1)
        number[keep] = np.arange(len(keep))
        to = number.tolist()
        for table in (self.known, self.ends):
            left = {c: to[i] for c, i in table.items() if i >= 0 and to[i] >= 0}
            table.clear()
            table.update(left)
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.uses = self.uses[keep] // 2
        self.figures = [figures[keep]]
        sizes = np.diff(pairs.starts)[keep]
        entries = spread(pairs.starts[keep], sizes)
        self.pairs = [Csr(np.concatenate([[0], np.cumsum(sizes)]), pairs.columns[entries], pairs.values[entries])]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text after a space, each without its first space."""
        out, held = [], None
        for piece in text.split(" "):
            held = piece if held is None else f"{held} {piece}"
            if not is_open(piece):
                out.append(held)
                held = None
        return out if held is None else [*out, held]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        # B adds no space to nothing: a single space at the end of a text
        b = [ids if c else [self.b.piece_to_id(SPACE)] for c, ids in zip(chunks, self.b.encode(chunks, num_threads=1))]
        return [e.ids for e in a], b

    def _agree(self, chunks: list[str], every_a: list[list[int]], every_b: list[list[int]]) -> list[bool]:
        """Whether the tokens of both have the bytes of each chunk and its space."""
        raw = [b" " + c.encode() for c in chunks]
        joined = [[b"".join(map(entries.__getitem__, ids)) for ids in every] for every, entries in ((every_a, self.a_bytes), (every_b, self.b_bytes))]
        return [a == r == b for r, a, b in zip(raw, *joined)]

    def _add(self, chunks: list[str]) -> None:
        """Tokenize and align chunks that are not known yet; they get the next numbers."""
        every_a, every_b = self.encode(chunks)
        agree = self._agree(chunks, every_a, every_b)
        every_a, every_b = ([ids if fine else [] for ids, fine in zip(every, agree)] for every in (every_a, every_b))
        n = len(chunks)
        sides = []
        for every, size in ((every_a, self.a_size), (every_b, self.b_size)):
            counts = np.fromiter(map(len, every), np.int64, n)
            ids = np.fromiter((i for ids in every for i in ids), np.int64, int(counts.sum()))
            sides.append((ids, np.cumsum(size[ids]), np.repeat(np.arange(n), counts), counts))
        (a, a_end, a_chunk, n_a), (b, b_end, b_chunk, n_b) = sides
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        n_bytes = int(a_end[-1]) if len(a_end) else 0
        token_bytes = Csr(np.concatenate([[0], a_end]), np.arange(n_bytes), np.ones(n_bytes, np.int64))
        byte_tokens = Csr(np.arange(n_bytes + 1), np.repeat(np.arange(len(b)), self.b_size[b]), np.ones(n_bytes, np.int64))
        overlaps = np.diff(product(token_bytes, byte_tokens).starts)
        # rows are the ids of A in each chunk, in the order of chunks
        rows, row_of = np.unique(a_chunk * len(self.a_bytes) + a, return_inverse=True)
        links = product(gather(row_of, a_group, np.ones(len(a), np.int64), len(rows)),
                        gather(b_group, b, np.ones(len(b), np.int64), len(cuts)))
        row_chunk, sizes = rows // len(self.a_bytes), np.diff(links.starts)
        keys = np.repeat(rows % len(self.a_bytes), sizes) * self.width + links.columns
        starts = np.concatenate([links.starts, links.starts[-1:]])[np.searchsorted(row_chunk, np.arange(n + 1))]
        self.pairs.append(Csr(starts, keys, links.values))
        first = np.zeros(len(a), bool)
        first[np.unique(a_group, return_index=True)[1]] = True
        n_groups = np.bincount(a_chunk[first], minlength=n)
        n_links = np.bincount(np.repeat(row_chunk, sizes), links.values, n).astype(np.int64)
        n_overlaps = np.bincount(a_chunk, overlaps, n).astype(np.int64)
        self.figures.append(np.stack([n_a, n_b, n_groups, n_links, n_overlaps, np.array(agree, np.int64)], axis=1))
        self.groups += _group_texts(n, (a, a_group), (b, b_group), n_groups)

    def _numbers(self, text: str) -> list[int]:
        found = list(map(self.known.__getitem__, text.split(" ")))
        if -1 in found:
            return [(self.ends if " " in c or is_open(c) else self.known)[c] for c in self.chunks(text)]
        return found

    def _numbered(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of the chunks of each text, all of them aligned."""
        if len(self.groups) > REMEMBERED:
            self._forget_rare()
        numbers = [self._numbers(t) if t else [] for t in texts]
        new, self.new = self.new, []
        for at in range(0, len(new), AT_ONCE):
            self._add(new[at:at + AT_ONCE])
        return numbers

    def memory(self) -> tuple[np.ndarray, Csr]:
        """Figures and pairs of all known chunks."""
        self.figures = [np.concatenate(self.figures)]
        offsets = np.cumsum([0, *[len(p.columns) for p in self.pairs[:-1]]])
        starts = np.concatenate([[0], *[p.starts[1:] + o for p, o in zip(self.pairs, offsets)]])
        self.pairs = [Csr(starts, np.concatenate([p.columns for p in self.pairs]), np.concatenate([p.values for p in self.pairs]))]
        return self.figures[0], self.pairs[0]

    def slice(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], Csr]:
        """Of each text: figures, digest of its groups, and the links of each id pair."""
        numbers = self._numbered(texts)
        figures, pairs = self.memory()
        counts = np.fromiter(map(len, numbers), np.int64, len(texts))
        flat, doc = np.fromiter((i for some in numbers for i in some), np.int64, int(counts.sum())), np.repeat(np.arange(len(texts)), counts)
        self.uses = np.concatenate([self.uses, np.zeros(len(figures) - len(self.uses), np.int64)]) + np.bincount(flat, minlength=len(figures))
        spoiled = np.bincount(doc, figures[flat, -1] == 0, len(texts)) > 0
        keep = ~spoiled[doc]
        sums = np.stack([np.bincount(doc[keep], figures[flat[keep], k], len(texts)).astype(np.int64) for k in range(len(_FIGURES))], axis=1)
        groups = self.groups
        digests = [hashlib.sha256(";".join([groups[i] for i in some]).encode()).hexdigest() if some and not bad else ""
                   for some, bad in zip(numbers, spoiled.tolist())]
        return sums, digests, product(gather(doc[keep], flat[keep], np.ones(int(keep.sum()), np.int64), len(texts)), pairs)

    def spans(self, text: str) -> list[tuple[int, int, list[int], list[int]]]:
        """(start, length, ids of A, ids of B) of each group of a text."""
        numbers = self._numbered([text])[0]
        if not all(self.memory()[0][i, -1] for i in numbers):
            return []
        out, at = [], 0
        for i in numbers:
            for group in self.groups[i].split(";"):
                a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
                length = int(self.a_size[a].sum())
                out.append((at, length, a, b))
                at += length
        return out


def _group_texts(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n_groups: np.ndarray) -> list[str]:
    """The groups of each chunk: `a1,a2|b1;a3|b2,b3`."""
    sides = []
    for ids, group in (a, b):
        said, ends = list(map(str, ids.tolist())), np.searchsorted(group, np.arange(int(n_groups.sum())), "right").tolist()
        sides.append([",".join(said[s:e]) for s, e in zip([0, *ends], ends)])
    each = [f"{x}|{y}" for x, y in zip(*sides)]
    ends = np.cumsum(n_groups).tolist()
    return [";".join(each[s:e]) for s, e in zip([0, *ends], ends)]


def _by_slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str | None]]]:
    sizes = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        some = batch.slice(at, to - at)
        yield some.column(0).to_pylist(), some.column(1).to_pylist()
        at = to


def _packed(values: np.ndarray) -> bytes:
    """In as few bytes each as the largest needs; how many follows from the length."""
    return values.astype(np.result_type(np.int8, np.min_scalar_type(-int(values.max(initial=0))))).tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The aligned documents, a row per slice. Costly: stage it."""
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts in _by_slices(batch):
                figures, digests, links = both.slice(texts)
                pairs, columns, n_docs = np.unique(links.columns, return_inverse=True, return_counts=True)
                row = [number, ids, *figures.T.tolist(), digests, pairs.tolist(), n_docs.tolist(), links.starts.astype("<i8").tobytes(),
                       columns.astype("<i4").tobytes(), _packed(links.values)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SLICE)], schema=_SLICE)
                number += 1
    return _rows(docs).mapInArrow(make, _SLICE_DDL)


def _asked(made: DataFrame) -> DataFrame:
    """(slice, place, pair, n_docs): the pairs of every slice and in how many of its documents each is linked."""
    return made.select("slice", F.posexplode(F.arrays_zip("pair", "n_docs")).alias("place", "p")).select("slice", "place", "p.pair", "p.n_docs")


def pair_counts(made: DataFrame, width: int) -> DataFrame:
    """(pair, a_id, b_id, count, best) of all linked id pairs: in how many documents each is linked, and whether none with the
    same id of A is in more. An id of A has no more pairs than B has ids."""
    counts = _asked(made).groupBy("pair").agg(F.sum("n_docs").alias("count"))
    rows = counts.select("pair", F.expr(f"pair div {width}").alias("a_id"), F.expr(f"pair % {width}").alias("b_id"), "count")
    return rows.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a_id")))


def digests(made: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per document of the slices: its figures, how many links are the best of their id, the sum of the links' counts."""
    told = _asked(made).select("slice", "place", "pair").join(counts.select("pair", "count", "best"), "pair")
    told = told.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("told"))
    rows = made.select("slice", "doc_id", *_FIGURES, "digest", "starts", "columns", "values").join(told, "slice", "left")
    names = ["doc_id", *_FIGURES, "digest", "starts", "columns", "values"]

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, *figures, digest, starts, columns, values = (row.column(k)[0].as_py() for k in range(len(names)))
                starts, columns = np.frombuffer(starts, "<i8"), np.frombuffer(columns, "<i4")
                values = np.frombuffer(values, f"<i{len(values) // max(1, len(columns)) or 1}").astype(np.int64)
                count, best = (row.column(k).flatten().to_numpy(zero_copy_only=False) if len(columns) else np.zeros(0, np.int64)
                               for k in (len(names), len(names) + 1))
                sums = []
                for per_pair in (best.astype(np.int64), count):
                    total = np.concatenate([[0], np.cumsum(per_pair[columns] * values)])
                    sums.append(total[starts[1:]] - total[starts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((ids, *figures, *sums, digest), _DOC)], schema=_DOC)

    flat = rows.select(*names, F.transform("told", lambda t: t["count"]).alias("count"), F.transform("told", lambda t: t["best"]).alias("best"))
    return flat.mapInArrow(multiply, _DOC_DDL)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256) of every document."""
    made = stage(slices(docs, a, b))
    return digests(made, pair_counts(made, aligner(a, b).width))


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, group, start, length, a_ids, b_ids): every group of every document, by bytes of the space and the text."""
    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = both.spans(text or "")
                columns = [[doc_id] * len(found), range(len(found)), *(zip(*found) if found else [()] * 4)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _GROUP)], schema=_GROUP)
    return _rows(docs).mapInArrow(spans, _GROUP_DDL)
