"""Spelling variants against all pairs of words, and the query's words against a plain count."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tablelens.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words, times):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def check(spark, words, times=10):
    table = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    rows = spelling.variants(table, times=times).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain(words, times) and len(rows) == len(words)


def test_words_of_few_letters(spark):
    words = ["".join(w) for k in range(6) for w in itertools.product("ab", repeat=k)]
    rng = random.Random(1)
    check(spark, {w: 10 ** rng.randint(0, 4) for w in words}, 10)


def test_marks_accents_and_long_words(spark):
    rng = random.Random(2)
    words = ["$", "a$", "$$", "a$b", "ab", "", "é", "ée", "😀a", "a😀", "0", "$$0$0"]
    for length in (62, 63, 64, 65, 66, 67, 300):
        base = "ab" * (length // 2) + "c" * (length % 2)
        words += [base, base[:-1], base + "z", base[:40] + "$" + base[41:], "q" + base[1:], base[:30] + "b" + base[30:], base[:31] + "éé"[:1] + base[32:]]
    check(spark, {w: 10 ** rng.randint(0, 5) for w in words}, 10)


@pytest.mark.parametrize("seed", range(2))
def test_random_words_with_ties(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc$") for _ in range(rng.randint(3, 7))) for _ in range(600)}
    check(spark, {w: rng.choice([1, 1, 10, 100, 100]) for w in words}, 10)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([(None, 3)], "word string, n long")).count() == 0


def test_words_of_documents(spark):
    texts = ["Straße WORDING wordings×÷ ÀÉÿabcd", None, "", "wording, wording-wording2wording", "ſhorter longest " * 400, "short"]
    docs = [(i or None, t) for i, t in enumerate(texts)] * 2
    want = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += len(run) >= 7
    got = spelling.word_counts(queries.corpus_words(spark.createDataFrame(docs, "doc_id long, text string")), 1)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n}
