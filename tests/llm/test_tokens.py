"""Token ids, packing and token files against plain whole-text computations."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.llm import packing, rans, token_files
from tablelens.llm.token_ids import coder

SF_DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a  b", " a b", "a b ", "a\n\nb", "a \n b", "a\tb c", "x\x01y z \x01", "don't I'll 'S", " x y ",
       "a\x1cb c", "é ́a b", "ΣΑΣ ΟΔΟΣ. İ", "12 345.67, ", "<|endoftext|> x<|endoftext|>y", ". , ., ..", "中文 字。"]


def plain_ids(name, text):
    return np.array(coder(name).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_those_of_whole_texts(name):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab .,\n\t\x01é'1|中 Σ") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    assert coder(name).encode(texts) == [plain_ids(name, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.integers(1, 400))
def test_segments_round_trip(ids, times):
    data = np.array(ids * times, "<u4")
    assert (rans.decode(rans.encode(data)) == data).all()


def test_segment_of_rare_and_frequent_ids():
    data = np.concatenate([np.zeros(200_000, np.uint32), np.arange(50_000, dtype=np.uint32)])
    coded = rans.encode(data)
    assert (rans.decode(coded) == data).all()
    damaged = coded[:-3] + b"abc"
    with pytest.raises(ValueError):
        rans.decode(damaged)


def rows_of(spark):
    texts = [*ODD, "word " * 5000, "word " * 5000, "one two three"]
    return spark.createDataFrame(
        [(i if i else None, t, "x", i) for i, t in enumerate(texts)] + [(5, "a b", "x", 0)] * 2,
        "doc_id long, text string, row string, start int")


def check_pieces(rows, docs, capacity):
    want = []
    for doc_id, text in docs:
        ids = plain_ids("word_bpe_49k.json", text) + bytes(4)
        for k, i in enumerate(range(0, len(ids), 4 * capacity)):
            chunk = ids[i:i + 4 * capacity]
            want.append((doc_id, k, i // 4, len(chunk) // 4, zlib.crc32(chunk)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("group_rows", [4, 1000])
def test_packing(spark, group_rows):
    docs = rows_of(spark)
    rows = packing.pack(docs, capacity=64, group_rows=group_rows).collect()
    used = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 64)
    assert used <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack(docs.limit(0), capacity=64).count() == 0


def test_packing_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = packing.pack(docs).collect()
    used = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= 1.05 * sum(r.length for r in rows) / 2048 + 1


def test_no_words_are_held_after_packing(spark):
    docs = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    assert packing.pieces(docs, 64, "word_bpe_49k.json", 0).count() == 400

    def held(batches):
        list(batches)
        from tablelens.llm.token_ids import _coders
        yield pa.RecordBatch.from_pydict({"n": [len(c.known) + len(c.known.older) for c in _coders.values()] or [-1]})

    found = [r.n for r in docs.mapInArrow(held, "n long").collect()]
    assert max(found) == 0  # a worker that has packed, and nothing left in it


def test_few_open_bins_close_the_fullest():
    bins, offsets, left = packing.best_fit([6, 5, 4, 9, 1], 10, 2)
    assert (bins, offsets) == ([0, 1, 0, 2, 2], [0, 0, 6, 0, 9]) and left == {1: 5}
    assert packing.best_fit([6, 7, 8, 3], 10, 2)[0] == [0, 1, 2, 0]  # the bin of 7 is the best fit, but it closed for 8
    assert packing.best_fit([6, 7, 8, 3], 10, 3)[0] == [0, 1, 2, 1]


def test_pieces_are_taken_as_they_arrive(spark, monkeypatch):
    lengths = [3, 8, 2, 9, 5, 1, 4, 4, 6, 2]
    items = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    got = sorted(map(tuple, packing._packed(items, len(lengths), 0, 10, 2, 100).select("row", "bin", "place").collect()))
    bins, places, _ = packing.best_fit(lengths, 10, 2)
    assert [(b, at) for _, b, at in got] == list(zip(bins, places))
    # by hand; before the 6 two bins have the same free space, and the one touched last closes
    assert bins == [0, 1, 1, 2, 0, 2, 3, 3, 4, 0]


@pytest.mark.parametrize(("open_bins", "group_rows"), [(20, 10), (1, 2), (3, 7)])
def test_pieces_that_never_share_a_bin_come_to_an_end(spark, open_bins, group_rows):
    text = " ".join(["word"] * 40)  # more than half of the capacity
    docs = spark.createDataFrame([(i, text) for i in range(65)], "doc_id long, text string")
    rows = packing.pack(docs, capacity=64, open_bins=open_bins, group_rows=group_rows).collect()
    assert check_pieces(rows, [(i, text) for i in range(65)], 64) == 65
    with pytest.raises(ValueError):
        packing.pack(docs, group_rows=1)


def test_token_files(spark):
    docs = rows_of(spark)
    files = token_files.segments(docs, "byte_bpe_50k.json", 2, segment_tokens=50)
    got = token_files.documents(files).collect()
    source = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for doc_id, text in source:
        ids = plain_ids("byte_bpe_50k.json", text) + (2).to_bytes(4, "little")
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.documents(token_files.segments(docs.limit(0), "byte_bpe_50k.json", 2)).count() == 0
