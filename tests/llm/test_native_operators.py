"""Chat formatting, quality rules, sharding and licence scan: defined cases and brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelens.llm import chat_format, kd_shards, licence_texts, license_scan, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# chat formatting

NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "\x1b0\x1b1", "[\x1b1INST]", "<</s>s>", "[ROLE]x[/ROLE]", "[IMG] [DOC]", "ü\n\U0001f600", "[/INST][/INST]"]


def test_texts_and_roles_come_back(spark):
    rng = random.Random(1)
    parts = [*"<>/s[]INSTROLE", "\x1b", "0", "1", "</s>", "[INST]"]
    texts = NASTY + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    roles = ["user", "assistant", "system", None, "[/ROLE]", "assistant"]
    rows = [(i // 7, i % 7, roles[i % 6], t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c int").withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        assert got[conv].loss_text == "".join(t for role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own)


def test_parts_become_placeholders(spark):
    df = spark.sql("""SELECT 1L AS conv_id, 0 AS turn, 'user' AS role, array(
        named_struct('type', 'text', 'text', 'see [IMG]', 'ref', NULL, 'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', NULL),
        named_struct('type', 'image', 'text', NULL, 'ref', 'a.png', 'width', 57, 'height', 28, 'seconds', NULL, 'pages', NULL),
        named_struct('type', 'audio', 'text', NULL, 'ref', 'b.wav', 'width', NULL, 'height', NULL, 'seconds', 2.1D, 'pages', NULL),
        named_struct('type', 'document', 'text', NULL, 'ref', 'c.pdf', 'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', 3),
        named_struct('type', 'image', 'text', NULL, 'ref', NULL, 'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', NULL),
        named_struct('type', NULL, 'text', '!', 'ref', NULL, 'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', NULL)) AS parts
        UNION ALL SELECT 1L, 1, 'assistant', NULL""")
    row = chat_format.read_back(chat_format.format_chats(df)).first()
    assert row.formatted == "<s>[ROLE]user[/ROLE][INST]see [\x1b1IMG][IMG][AUDIO][DOC][IMG]![/INST]</s><s>[ROLE]assistant[/ROLE]</s>"
    assert [tuple(a) for a in row.attachments] == [
        (1, 1, "image", "a.png", 3), (1, 2, "audio", "b.wav", 27), (1, 3, "document", "c.pdf", 2400), (1, 4, "image", None, 0)]
    assert [tuple(s) for s in row.loss_mask] == [(len(row.formatted) - 4, 0)]


def test_conversations_without_id_or_learned_turn(spark):
    df = spark.createDataFrame([(None, None, "user", "b"), (None, 1, "user", "a"), (2, 1, "x", "y"), (2, 1, "x", "y")],
                               "conv_id long, turn int, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [t.text for t in got[None].turns] == ["b", "a"] and got[None].loss_text == "" and got[2].n_turns == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


# quality rules

def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark):
    rng = random.Random(2)
    texts = [None, "", "\n \n", "a", "x " * 7, "a b c d e a b c d e", "\x1c b\x0bc", "ü" * 9000, "| # |\n| # |\n\n| # |", "A!! B??"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(texts)]
    out = quality_rules.judged(quality_rules.figures(spark.createDataFrame(rows, "doc_id long, text string, votes string, n_words string")))
    got = {r.doc_id: r for r in out.collect()}
    for i, t, *_ in rows:
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and 0 <= r.quality <= 1 and not (failed and r.kept)
    empty = quality_rules.judged(quality_rules.figures(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0


def test_estimation_finds_the_classes():
    rng = random.Random(3)
    truth = {"g": ((0.0, 0.9),) * 4, "b": ((0.8, 0.1), (0.7, 0.2), (0.0, 0.9), (0.1, 0.8))}
    votes = Counter()
    for _ in range(20_000):
        c = "g" if rng.random() < 0.85 else "b"
        v = ""
        for bad, good in truth[c]:
            x = rng.random()
            v += "b" if x < bad else "g" if x < bad + good else "-"
        votes[v] += 1
    fitted = quality_rules.fit(sorted(votes.items()), 4)
    assert abs(fitted.prior - 0.85) < 0.03
    assert abs(fitted.accuracy[0]["b"] - 0.8 / 0.9) < 0.05 and fitted.accuracy[2]["b"] < 0.1
    assert quality_rules.posterior("bbgg", fitted) < 0.01 < 0.9 < quality_rules.posterior("gggg", fitted)
    assert abs(quality_rules.posterior("----", fitted) - fitted.prior) < 1e-12
    assert quality_rules.fit([], 3).prior == 0.9


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.judged(quality_rules.figures(docs.select("doc_id", "text"))).where("NOT base_failed").select("doc_id", "kept").join(
        labels.select("doc_id", F.col("quality").alias("label")), "doc_id").toPandas()
    assert (out.kept == (out.label == 1)).mean() > 0.97
    assert out[out.label == 1].kept.mean() > 0.99


def test_filters_on_figures_leave_one_split_of_the_text(spark):
    docs = spark.createDataFrame([(1, "a b c\n" * 20), (2, None)], "doc_id long, text string")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        some = quality_rules.figures(docs).where("n_words >= 10 AND n_repeat_words * 100 <= n_words * 500 AND n_dup_lines > 2")
        plan = some._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("split(") == 2  # into words, and into lines
    assert [r["doc_id"] for r in some.collect()] == [1]


# sharding

def shards_of(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, cell int")
    got = kd_shards.shard(df, k).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(k))
    return got


@pytest.mark.parametrize("k", [1, 5, 24])
def test_shards_have_equal_bytes(spark, prose, k, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 100)
    rng = random.Random(k)
    rows = [(i, prose(rng, rng.randint(0, 30)), f"s{min(rng.randint(0, 9), 4)}", rng.choice("abc"), 1) for i in range(1500)]
    rows += [(2000 + i, "the same text", "s0", "a", 1) for i in range(700)]
    rows += [(None, None, None, None, None), (7, None, "s1", "a", 1), (8, "ü", None, "a", 1)]
    got = shards_of(spark, rows, k)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    largest = max(r.size for r in got)
    assert max(sizes.values()) - min(sizes[i] for i in range(k)) <= 5 * largest


def test_few_equal_or_no_documents(spark):
    assert len({r.shard for r in shards_of(spark, [(i, "x", "s", "l", 1) for i in range(48)], 24)}) == 24
    assert len(shards_of(spark, [(1, "x", "s", "l", 1)], 24)) == 1
    assert len(shards_of(spark, [(1, "x", "s", "l", 1)] * 5, 3)) == 5
    assert shards_of(spark, [], 24) == []


# licence scan

def test_licences_are_found_and_inherited(spark):
    rows = [
        ("r/LICENSE", "Some preamble here.\nReleased under the MIT License."), ("r/a.py", "x = 1"), ("r/sub/b.py", None),
        ("r/sub/deep/LICENCE.txt", "Licensed under the Apache License, Version 2.0."), ("r/sub/deep/c.py", ""), ("r/sub/deep/x/y/d.py", "z"),
        ("r/sub/e.py", "Text first. Licensed under CC BY-NC 4.0. And more text of any kind after it"), ("other/f.py", "all of this is under the"),
        ("top.py", "z"), (None, "All rights reserved."), ("r/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("r/sub/b.py", None), ("q/NOTICE", "nothing"), ("q/g.py", "v")]
    df = spark.createDataFrame([(i, p, t, "n") for i, (p, t) in enumerate(rows)], "id long, path string, text string, licence string")
    got = {r.id: r.licence for r in license_scan.licences(df, "id").collect()}
    names = {i: (x.name, x.origin, x.directory) for i, x in got.items()}
    assert names[0][:2] == ("MIT", "own") and names[10][:2] == ("GPL-3.0", "own") and names[6][:2] == ("CC-BY-NC-4.0", "own")
    assert names[1] == ("GPL-3.0", "inherited", "r") and names[2] == names[11] == ("GPL-3.0", "inherited", "r")  # both match wholly: the first name
    assert names[3][:2] == ("Apache-2.0", "own") and names[4] == names[5] == ("Apache-2.0", "inherited", "r/sub/deep")
    assert names[7] == names[8] == names[13] == names[12] == (None, None, None)
    assert names[9][:2] == ("proprietary", "own")
    assert license_scan.licences(df.limit(0), "id").count() == 0


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame(list(license_scan.TEMPLATES.items()), "id string, text string")
    got = license_scan.own_licences(df, "id").collect()
    assert {(r.id, r.licence, r.score) for r in got} == {(n, n, 1.0) for n in license_scan.TEMPLATES}
    with pytest.raises(ValueError):
        license_scan.own_licences(df, "id", templates={"X": "all and by"})


def test_whole_files_headers_and_identifiers_have_a_licence(spark):
    long = licence_texts.long_templates()
    want = {f"whole {i}": name for i, (name, _) in enumerate(long)}
    rows = [(f"whole {i}", "Copyright (c) 2031 Jo Doe and others\n\n" + text) for i, (_, text) in enumerate(long)]
    for i, (name, texts) in enumerate(licence_texts.HEADERS.items()):
        for j, text in enumerate(texts):
            own = ["x.py - does a thing", "Copyright (C) 2031  Jo Doe", "", *text.split("\n")]
            code = "\n\nimport os\n" + "\n".join(f"value{k} = os.path.join(here, 'name{k}')" for k in range(40))
            rows += [(f"# {i} {j}", "#!/usr/bin/env python\n" + "\n".join("# " + x for x in own) + code), (f"* {i} {j}", "/*\n" + "\n".join(own) + "\n*/" + code)]
            want |= {f"# {i} {j}": name, f"* {i} {j}": name}
    for name, line in (("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
                       ("MIT", "# SPDX-License-Identifier: (MIT OR BSD-3-Clause)"), ("CC-BY-4.0", "<!-- SPDX-License-Identifier: CC-BY-4.0 -->")):
        rows.append((line, line + "\nx = 1"))
        want[line] = name
    rows += [("code", "# Uses the license server of the firm.\nx = 1"), ("SPDX", "# SPDX-License-Identifier: LicenseRef-Own\nx = 1")]
    got = license_scan.own_licences(spark.createDataFrame(rows, "id string, text string").repartition(4), "id").collect()
    assert {r.id: r.licence for r in got} == want and all(0.75 <= r.score <= 1 for r in got)
