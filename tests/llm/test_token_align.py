"""Token alignment against a plain walk along both token lists, and the sparse products against dense ones."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.llm import csr, token_align

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "\n", "a  b", " a b", "a b ", "a\n\nb", "a \n b", "a\tb c", "a\u2581b c", "don't I'll", " x y\u3000z ", "a\x1cb c", "e\u0301 a",
       "<|endoftext|> x</s> <s>", "<0x41> <unk>", "中文 字。", "😀😀 x", "   lead", "trail   ", "12 345.67", "aaaaaaaaaaaaaaaa", "\x00 a", "a\u00a0 b", "¡¿ ¡"]


def plain(docs):
    both = token_align.aligner(A, B)
    counts, found = Counter(), []
    for text in docs:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, both.a_bytes), (b, both.b_bytes))]
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(table[i] for i in ids) != raw for ids, table in ((a, both.a_bytes), (b, both.b_bytes))):
            found.append(None)
            continue
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids, end) if start < e <= cut] for ids, end in zip((a, b), ends)])
            start = cut
        links = [(x, y) for g, h in groups for x in g for y in h]
        counts.update(set(links))
        starts = [[0, *e[:-1]] for e in ends]
        overlaps = sum(max(s, t) < min(e, f) for s, e in zip(starts[0], ends[0]) for t, f in zip(starts[1], ends[1]))
        found.append((len(a), len(b), groups, links, overlaps))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((f[0], f[1], len(f[2]), len(f[3]), f[4], sum(counts[k] == top[k[0]] for k in f[3]), sum(counts[k] for k in f[3]),
                    hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "b ", " ", "\n", "the ", "é", "中", "1", ".", "ing", "\u2003", "'s"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [*ODD, *made, "word another " * 3000, "word another " * 3000]


@pytest.mark.parametrize("slice_bytes, remembered, at_once", [(4 << 20, 500_000, 30_000), (300, 40, 7)])
def test_documents_agree_with_the_plain_walk(spark, texts, monkeypatch, slice_bytes, remembered, at_once):
    monkeypatch.setattr(token_align, "SLICE_BYTES", slice_bytes)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, slice string, pair int").repartition(3)
    if slice_bytes < 1000:  # small limits hold in this process only
        monkeypatch.setattr(token_align, "REMEMBERED", remembered)
        monkeypatch.setattr(token_align, "AT_ONCE", at_once)
        both = token_align.Aligner(A, B)
        got = [row for t in texts for row in zip(*(x.tolist() if hasattr(x, "tolist") else x for x in both.slice([t])[:2]))]
        assert [(*f, d) for f, d in got] == [(*p[:5], p[7]) for p in plain(texts)]
        return
    rows = {r.doc_id: tuple(r)[1:] for r in token_align.align(docs, A, B).collect()}
    assert rows == dict(enumerate(plain(texts)))


def test_many_slices_in_one_batch(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string").repartition(12)  # a slice each
    rows = {r.doc_id: tuple(r)[1:] for r in token_align.align(docs, A, B).collect()}
    assert rows == dict(enumerate(plain(texts[:300])))


def test_groups_cover_the_bytes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    both, want = token_align.aligner(A, B), plain(texts[:200])
    rows = token_align.groups(docs, A, B).orderBy("doc_id", "group").collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts[:200]):
        assert len(by_doc[i]) == want[i][2]
        if by_doc[i]:
            raw = (" " + text).encode()
            assert all(b"".join(both.a_bytes[x] for x in r.a_ids) == raw[r.start:r.start + r.length] == b"".join(both.b_bytes[x] for x in r.b_ids) for r in by_doc[i])
            assert sum(r.length for r in by_doc[i]) == len(raw)


def test_no_documents_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted(token_align.align(docs, A, B).collect(), key=str)
    assert [r.doc_id for r in rows].count(7) == 2 and [r.n_a for r in rows].count(2) == 3
    assert token_align.align(docs.limit(0), A, B).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 8), st.integers(1, 8), st.randoms(use_true_random=False), st.sampled_from([1, 5, 4_000_000]))
def test_products_are_those_of_dense_matrices(n, m, k, rng, block):
    left = np.array([[rng.choice([0, 0, 1, 3]) for _ in range(m)] for _ in range(n)])
    right = np.array([[rng.choice([0, 0, 0, 2]) for _ in range(k)] for _ in range(m)])

    def sparse(x):
        rows, columns = np.nonzero(x)
        return csr.gather(rows, columns, x[rows, columns], len(x))
    before, csr.BLOCK = csr.BLOCK, block
    try:
        p = csr.product(sparse(left), sparse(right))
    finally:
        csr.BLOCK = before
    dense = np.zeros((n, k), np.int64)
    dense[np.repeat(np.arange(n), np.diff(p.starts)), p.columns] = p.values
    assert (dense == left @ right).all()
