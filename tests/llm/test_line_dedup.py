"""Line deduplication against a search over all earlier runs."""

import random
import re

import pytest

from tablelens.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def units(text):
    return re.split(r"\n(?=[^\n]*[^\n\x20\x09-\x0D])", text)


def brute(rows, least):
    """Lines that lie in a run of at least `least` words which occurs earlier."""
    docs = sorted({(i, t) for i, t in rows if t is not None})
    parts = {d: [u.strip(BLANK) for u in units(d[1])] for d in docs}
    sizes = {d: [len(WORD.findall(u)) for u in parts[d]] for d in docs}
    first = {}
    for d in docs:  # every run of enough words, by its first place
        for a in range(len(parts[d])):
            for b in range(a + 1, len(parts[d]) + 1):
                if sum(sizes[d][a:b]) >= least:
                    first.setdefault(tuple(parts[d][a:b]), (d, a))
    gone = {}
    for d in docs:
        for a in range(len(parts[d])):
            for b in range(a + 1, len(parts[d]) + 1):
                if sum(sizes[d][a:b]) >= least and first[tuple(parts[d][a:b])] != (d, a):
                    gone.setdefault(d, set()).update(range(a, b))
    return {d: "\n".join(u for k, u in enumerate(units(d[1])) if k not in gone.get(d, ())) for d in docs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_that_occur_earlier_go(spark, prose, seed):
    rng = random.Random(seed)
    lines = [prose(rng, rng.choice([1, 2, 3, 5, 9, 14])) for _ in range(25)]
    rows = []
    for i in range(60):
        text = "\n".join(rng.choice(lines) if rng.random() < 0.85 else prose(rng, 3) for _ in range(rng.randint(0, 14)))
        rows.append((i, text.replace("\n", "\n \n") if rng.random() < 0.1 else text))
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, row string, did int, line_dedup int")
    got = {(r.doc_id, r.n): r.text for r in dedup_lines(df, min_words=10).selectExpr("doc_id", "text", "did AS n").collect()}
    want = brute(rows, 10)
    assert {k[0]: v for k, v in got.items()} == {k[0]: v for k, v in want.items()}


def test_defined_cases(spark):
    run = "a b c d\ne f g h"
    rows = [(1, None), (2, ""), (3, " \n\n"), (4, run), (None, run + "\nz"), (4, run), (5, "x\n" + run + "\ny"), (6, run + "\n" + run), (7, "k " * 900),
            (8, "k " * 900), (9, "q\n" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup_lines(df, min_words=8)
    assert out.columns == ["doc_id", "text", "line_dedup"]
    got = sorted(((r.doc_id, r.text, r.line_dedup.n_lines, r.line_dedup.n_removed_lines) for r in out.collect()), key=str)
    assert got == sorted([
        (1, None, 0, 0), (2, "", 1, 0), (3, " \n\n", 1, 0), (None, run + "\nz", 3, 0), (4, "", 2, 2), (4, "", 2, 2), (5, "x\ny", 4, 2),
        (6, "", 4, 4), (7, "k " * 900, 1, 0), (8, "", 1, 1), (9, "q", 300, 299)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0
