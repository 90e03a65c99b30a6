"""Word hashes, components and the n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablelens.llm import ngram_join
from tablelens.llm.components import components
from tablelens.llm.word_hashes import shingles, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "one two three", "one two\x0bthree", "ü É ß", "ü É ß x", "a" * 5000, " lead", "\x1c b"]


def own_words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def own_set(text, n):
    w = own_words(text)
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_hashes_tell_shingles_apart(n):
    rng = random.Random(n)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    seen, found = {}, []
    for part in words_of(pa.array(texts, pa.string())):
        values, bounds = shingles(part, n)
        found += [set(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert len(found) == len(texts)
    for text, got in zip(texts, found):
        want = own_set(text, n)
        assert len(got) == len(want)
        for s in want:
            seen[s] = None
    assert len(set().union(*found)) == len(seen)


def test_slices_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr("tablelens.llm.word_hashes.BYTES_AT_ONCE", 7)
    parts = list(words_of(pa.array(["a b", "cc", None, "a long text here", "d"]).slice(1)))
    assert [(p.first_row, p.rows) for p in parts] == [(0, 2), (2, 1), (3, 1)]
    assert sum(len(p.hashes) for p in parts) == 6


def groups_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups_of(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in text.split())


def check(spark, rows, n, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, node long, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(df, n=n, num=num, den=den).collect()}
    sets = {i: own_set(t, n) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups_of(links, sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_groups_are_those_of_all_pairs(spark, prose, n, num, den):
    rng = random.Random(n)
    texts = list(ODD)
    shared = prose(rng, 60)
    for k in range(12):
        base = prose(rng, rng.choice([4, 12, 40, 300]))
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08):
            texts.append(edited(rng, base, share) + (" " + shared if k % 3 == 0 else ""))
    for size in range(8, 20):  # chains at the threshold
        texts.append(" ".join(f"w{i}" for i in range(size)))
    check(spark, [(i, t, 1, 2, "x") for i, t in enumerate(texts)], n, num, den)


def test_small_tiles_and_batches(spark, prose, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, 0.004 * (i % 9)), None, None, None) for i in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, rows, 3, 90, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sketches_never_hide_a_shingle_in_common():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 90), (64, 65), (500, 520), (3000, 4500)]:
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[:n * 3 // 4], rng.integers(0, 2**63, m - n * 3 // 4).astype(np.uint64)]))
        a, b = (np.frombuffer(ngram_join._sketch(s), np.uint8) for s in (x, y))
        assert ngram_join._bits_apart(a, b) == ngram_join._bits_apart(b, a) <= len(np.setxor1d(x, y))
        assert ngram_join._bits_apart(a, a) == 0


@pytest.mark.parametrize("most", [1 << 26, 1 << 12])
def test_id_filters_hold_every_id(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "FILTER_MOST", most)
    rng = random.Random(4)
    rows = [(rng.randint(-2**62, 2**62), f"word {i}") for i in range(900)]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), [i for i, _ in rows[::3]]
    got = {r.node for r in ngram_join._full_sets(docs, spark.createDataFrame([(i,) for i in wanted], "id long"), 3).collect()}
    assert set(wanted) <= got
    assert len(got) < 400


def test_no_shuffle_of_texts_or_sets_that_no_link_needs(spark, prose):
    """Unlike documents of one passage: no set of theirs is made for an exact comparison."""
    rng = random.Random(8)
    shared = prose(rng, 1_000)
    texts = [shared + " " + prose(rng, 900) for _ in range(6)] + [prose(rng, 50)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    looks = ngram_join._scan(docs, 5).withColumnRenamed("doc_id", "node")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)] + [(6, 7)], "a long, b long")
    assert [tuple(r) for r in ngram_join._likely(pairs, looks, 80, 100).collect()] == [(6, 7)]
    plan = ngram_join._full_sets(docs, spark.createDataFrame([(1,)], "id long"), 5)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_nulls_and_no_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (None, "only here"), (4, None), (5, "")]
    got = sorted(map(tuple, ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 1, 3), (3, 1, 3), (None, 1, None), (4, 0, 4), (5, 0, 5)], key=str)
    assert ngram_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
