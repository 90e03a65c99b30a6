"""Language labels, decontamination and the pipeline: defined cases, brute force, held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablelens.llm import decontaminate, language_crf
from tablelens.llm.word_hashes import BYTES_AT_ONCE, words_of

SF_DIR = "/root/testdata/sf0.01"


# language labels

def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(0)
    texts = ["a b c\nd e", None, "", "f", "g h i j\n\nk l"]
    (words,) = words_of(pa.array(texts))
    n, k = len(words.starts), 3
    scores = rng.normal(size=(n, k)).astype(np.float32)
    model = language_crf.Model(list("xyz"), None, rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32))
    first, length = language_crf._chains(words)
    assert sorted(zip(first.tolist(), length.tolist())) == [(0, 3), (3, 2), (5, 1), (6, 4), (10, 2)]
    got, pairs = language_crf._marginals(scores, first, length, model)
    want, want_pairs = np.zeros((n, k)), np.zeros((k, k))
    for a, size in zip(first, length):
        total = 0
        single, double = np.zeros((size, k)), np.zeros((k, k))
        for path in np.ndindex(*(k,) * size):
            p = np.exp(model.start[path[0]] + sum(scores[a + t, y] for t, y in enumerate(path))
                       + sum(model.transitions[x, y] for x, y in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                single[t, y] += p
            for x, y in zip(path, path[1:]):
                double[x, y] += p
        want[a:a + size] = single / total
        want_pairs += double / total
    assert np.allclose(got, want, atol=1e-4) and np.allclose(pairs, want_pairs, atol=1e-3)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("held_out", language_crf.is_held_out(F.col("doc_id")))
    model = language_crf.fit(docs.where("NOT held_out").select("text", "lang", F.col("doc_id").alias("key")), sample_docs=200)
    rows = language_crf.predict(docs, model, ["doc_id", "lang", "held_out"]).toPandas()
    own = rows[rows.held_out]
    assert len(own) > 100 and (own.lang == own.lang_pred).mean() > 0.98 and rows.score.between(0, 1).all()
    # a text that switches its language between lines
    texts = {r.lang: r.text for r in docs.where("held_out AND n_chars BETWEEN 800 AND 3000").select("lang", "text").collect()}
    (words,) = words_of(pa.array([texts["de"] + "\n" + texts["fr"]]))
    labels = language_crf.label_words(words, model).argmax(axis=1)
    n_de = len(re.findall(r"[^\x20\x09-\x0D]+", texts["de"]))
    assert (labels[:n_de] == model.labels.index("de")).mean() > 0.9 and (labels[n_de:] == model.labels.index("fr")).mean() > 0.9


def test_odd_texts_have_a_defined_language(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of to", "en"), (None, None, None), (4, "", "en"), (5, "12 ... 34", "en"), (6, "x" * 40_000, "en"), (2, "the and of to", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("taken"))
    model = language_crf.fit(df.select("text", "lang", F.col("doc_id").alias("key")))
    assert model.labels == ["de", "en"]
    got = [tuple(r) for r in language_crf.predict(df.drop("score"), model, ["doc_id"]).collect()]
    assert [(i, p) for i, p, _ in got] == [(1, "de"), (2, "en"), (None, "und"), (4, "und"), (5, "und"), (6, got[5][1]), (2, "en")]
    none = language_crf.fit(df.where("lang IS NULL").select("text", "lang", F.col("doc_id").alias("key")))
    assert none is None and {r.lang_pred for r in language_crf.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert language_crf.predict(df.limit(0), model, ["doc_id"]).count() == 0


def test_texts_go_to_the_tasks_once_and_come_back_in_small_batches(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, None if i == 7 else "".join(rng.choices("abcdefgh \n", k=2000)), "ab"[i % 2], i) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `own row` long")
    model = language_crf.fit(docs.where("doc_id < 20").select("text", "lang"))
    calls, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, task, *more, **named: calls.append((df, task)) or plain(df, task, *more, **named))
    keep = ["own row", "text", "doc_id"]
    got = language_crf.predict(docs, model, keep, certainty=True)
    ((sent, task),) = calls
    table = sent.toArrow().combine_chunks()
    size = sum(len(t or "") for _, t, *_ in rows)
    assert table.nbytes < 1.1 * size
    (batch,) = table.to_batches()
    out = list(task(iter([batch])))
    assert len(out) >= size / BYTES_AT_ONCE and max(b.nbytes for b in out) < 1.2 * BYTES_AT_ONCE
    assert got.columns == [*keep, "lang_pred", "score", "certainty"]
    assert sorted(map(tuple, got.select(*[f"`{k}`" for k in keep]).collect())) == [(r[3], r[1], r[0]) for r in rows]
    alone = language_crf.predict(docs, model, ["doc_id"], certainty=True)
    columns = ["doc_id", "lang_pred", "score", "certainty"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, alone.select(*columns).collect()))


def test_language_id_keeps_columns_named_like_those_it_adds(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("lang IN ('en', 'de')").limit(200)
    docs = docs.select("lang", "text", "doc_id", F.lit("taken").alias("lang_pred"), F.lit(-1.0).alias("certainty"), F.struct("n_chars").alias("row"))
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and out.count() > 100
    assert out.exceptAll(docs).count() == 0


def test_rare_labels_are_learned_and_copies_count_once(spark):
    rng = random.Random(9)
    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(12))
    copy = text("abcd")
    rows = [(i, copy, "aa") for i in range(600)] + [(1000 + i, text("abcd"), "aa") for i in range(300)]
    rows += [(2000 + i, text("efgh"), "bb") for i in range(300)] + [(3000 + i, text("ijkl"), "cc") for i in range(2)]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    seen = []
    train = language_crf.train
    try:
        language_crf.train = lambda texts, labels: seen.append((texts, labels)) or train(texts, labels)
        model = language_crf.fit(df.repartition(7), sample_docs=60)
        language_crf.fit(df.repartition(3).withColumn("key", -F.col("key")), sample_docs=60)
    finally:
        language_crf.train = train
    assert model.labels == ["aa", "bb", "cc"] and seen[0] == seen[1]
    texts, labels = seen[0]
    assert [labels.count(x) for x in model.labels] == [60, 60, 2] and len(set(texts)) == len(texts)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for label in ("aa", "bb"):  # the least hashes, without signs
        own = sorted({hashes[t] % 2**64 for _, t, x in rows if x == label})[:60]
        assert sorted(hashes[t] % 2**64 for t, x in zip(texts, labels) if x == label) == own
    got = language_crf.predict(spark.createDataFrame([(text("ijkl"),), (text("efgh"),)], "text string"), model, []).collect()
    assert [r.lang_pred for r in got] == ["cc", "bb"]


def test_text_of_an_unlearned_language_is_rejected(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("lang IN ('en', 'de')").select("doc_id", "text", "lang")
    greek = "Η ζωή είναι ωραία και ο κόσμος μεγάλος. Κάθε μέρα μαθαίνουμε κάτι νέο από τους ανθρώπους γύρω μας."
    more = spark.createDataFrame([(-1, greek, None)], "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), str(tmp_path)).collect()}
    assert left == {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert corpus_pipeline.least_certainty(2) == 0.725 and corpus_pipeline.least_certainty(1) == 0


# decontamination

def plain_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), (0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            if h[i, j] > best[0]:
                best = (int(h[i, j]), j)
    return best


def test_alignment_equals_the_plain_recursion():
    rng = random.Random(4)
    items = [np.array([rng.randint(2, 6) for _ in range(rng.randint(1, 15))], np.uint64) for _ in range(80)]
    windows = [np.array([rng.randint(2, 6) for _ in range(rng.randint(1, 30))], np.uint64) for _ in range(80)]
    score, _ = decontaminate.align(items, windows)
    assert score.tolist() == [plain_alignment(a, b)[0] for a, b in zip(items, windows)]


@pytest.mark.parametrize("block_chars", [600, 10**6])
def test_copies_with_edits_are_found_and_clean_documents_left(spark, prose, block_chars):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)] + [(90, "too short"), (91, None), (92, ""), (93, items_text := prose(rng, 20)), (94, items_text)]
    docs, want = [], set()
    for i in range(60):
        text = prose(rng, rng.randint(0, 120))
        if i % 3 == 0:
            item, source = items[i % 12]
            leak = source.split()
            for _ in range(len(leak) // 8):  # words replaced, put in and left out
                k = rng.randrange(len(leak))
                leak[k:k + rng.randint(0, 1)] = ["edited"] * rng.randint(0, 1)
            text += " " + " ".join(leak).upper() + "\n" + prose(rng, 30)
            want.add((i, item))
        docs.append((i, text, "x", 0.5))
    docs += [(100, None, "x", None), (101, "", "x", None), (102, items_text, "x", 1.0), (102, items_text, "x", 1.0), (103, "too short", "x", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.leaks(df, bench, block_chars=block_chars).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want | {(102, 93), (102, 94)}
    whole = [r for r in rows if r.doc_id == 102]
    assert len(whole) == 4 and all((r.score, r.start_word, r.end_word) == (1.0, 0, 20) for r in whole)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_leaks_equal_the_alignment_of_all_items_and_documents(spark, prose):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([8, 9, 12, 20, 20, 35]))) for i in range(40)]
    own = "the item of twenty words that no one else has and whose every fifth word in this copy was changed by us".split()
    items.append((40, " ".join(own[:20])))
    docs = [(0, " ".join("edited" if k in (4, 9, 14) else w for k, w in enumerate(own[:20])))]
    inserted = items[3][1].split()
    docs.append((1, " ".join(w + (" put in" if k % 4 == 3 else "") for k, w in enumerate(inserted))))
    for i in range(2, 42):  # one edited copy per item, 10 to 30 per cent of its words changed, among other words
        leak = items[i - 2][1].split()
        for k in rng.sample(range(len(leak)), round(len(leak) * rng.choice([0.1, 0.2, 0.25, 0.3]))):
            leak[k] = rng.choice(["", "edited", "put in", "edited"])
        docs.append((i, prose(rng, rng.randint(0, 60)) + " " + " ".join(leak) + " " + prose(rng, rng.randint(0, 60))))
    docs += [(50 + k, items[20][1]) for k in range(5)]  # whole copies raise the counts of all seeds
    def hashes(texts):
        return [w.hashes[w.bounds[r]:w.bounds[r + 1]] for w in words_of(pa.array(texts)) for r in range(w.rows)]
    want = {}
    for (d, _), text in zip(docs, hashes([t for _, t in docs])):
        for (i, _), words in zip(items, hashes([t for _, t in items])):
            best = plain_alignment(words, text)[0]
            if best >= max(len(words) / 2, 4):
                want[d, i] = best / len(words)
    assert (0, 40) in want and len(want) > 30
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == want and len(rows) == len(want)


# the pipeline

def test_stages_take_effect(spark, prose, tmp_path):
    rng = random.Random(6)
    passage = prose(rng, 70)
    item = prose(rng, 30)
    base = prose(rng, 200)
    rows = [(i, prose(rng, 80) + "\n" + prose(rng, 20), "en", "s") for i in range(30)]
    rows += [(100, "1234 ... 5678", "en", "s"), (101, None, "en", "s")]  # no letter
    rows += [(110, prose(rng, 30) + "\n" + passage, "en", "s"), (111, prose(rng, 40) + "\n" + passage, "en", "s")]  # a repeated passage
    rows += [(120, base, "en", "s"), (121, base, "en", "s"), (122, base.replace(" ", "  ", 3), "en", "s")]  # copies
    rows += [(130, base + " one more end", "en", "s")]  # a near copy
    rows += [(140, prose(rng, 50) + " " + item + " " + prose(rng, 50), "en", "s")]  # a leak
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, a, b, len(t) if t else None) for i, t, a, b in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept, columns = spark.read.parquet(f"{folder}/documents.parquet"), [], ["doc_id", "text", "lang", "source", "n_chars"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    every = {r[0] for r in rows}
    assert set(kept[0]) == every - {100, 101}
    assert set(kept[1]) == every - {100, 101, 121} and kept[1][111] == rows[33][1].split("\n")[0] and kept[1][110] == rows[32][1]
    assert set(kept[2]) == every - {100, 101, 121, 122, 130}
    assert set(kept[3]) == every - {100, 101, 121, 122, 130, 140}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and sum(r.piece == 0 for r in packed) == len(kept[3])


def test_one_row_of_each_group_stays(spark, prose):
    rng = random.Random(9)
    copy, other, third = (prose(rng, 60) for _ in range(3))
    rows = [(1, copy, "a"), (1, copy, "a"), (1, copy, "b"), (2, copy, "c"), (None, copy, "d"), (None, copy, "d")]
    rows += [(None, other, "e"), (None, other, "e"), (None, other + " more", "f")]  # no id at all
    rows += [(5, third, "g"), (5, prose(rng, 60), "h"), (9, third, "i")]  # an id of two texts
    rows += [(7, "", "j"), (8, None, "k"), (8, None, "k"), (10, "short", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("id", F.lit(3)).withColumn("own", F.lit("x"))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.row) for r in out.collect()), key=str)
    alone = [r for r in got if r[0] is None]
    assert len(alone) == 1 and alone[0][1] in "ef"
    assert [r for r in got if r[0] is not None] == sorted([(1, "a"), (5, "h"), (9, "i"), (7, "j"), (8, "k"), (10, "l")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
