"""Splits, metrics and neighbours against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import knn
from tablelens.operators import metrics as met
from tablelens.operators import split as sp


def by_hash(keys, salt):
    return sorted(keys, key=lambda k: hashlib.md5(f"{salt}|{k}".encode()).hexdigest())


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(sp, "BUCKET_ROWS", 16)


@pytest.mark.parametrize("n", [1, 2, 7, 29, 30, 1001])
def test_holdout(spark, many_buckets, n):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(5)
    got = {r["k"]: r["part"] for r in sp.holdout_split(df, ["k"], n, fraction=0.1).assign(df, "part").collect()}
    share = 0.2 if n < 30 else 0.1
    tests = set(by_hash(range(n), "42")[: math.ceil(n * share)])
    assert {k for k, p in got.items() if p == 0} == tests and len(got) == n


def test_kfold(spark, many_buckets):
    df = spark.range(503).withColumnRenamed("id", "k")
    got = {r["k"]: r["f"] for r in sp.kfold(df, ["k"], 503, 4, seed=7).assign(df, "f").collect()}
    order = by_hash(range(503), "7f")
    assert [got[k] for k in order] == [0] * 126 + [1] * 126 + [2] * 126 + [3] * 125


def classes(spark, n=900):
    label = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 20, "small").otherwise(F.concat(F.lit("c"), F.col("id") % 7))
    return spark.range(n).select(F.col("id").alias("k"), label.alias("c"))


def test_stratified_holdout(spark, many_buckets):
    df = classes(spark)
    rows = [tuple(r) for r in df.collect()]
    got = {r["k"]: r["p"] for r in sp.stratified_holdout(df.repartition(7), "c", ["k"]).assign(df, "p").collect()}
    sizes = {}
    for k, c in rows:
        sizes.setdefault(c, []).append(k)
    assert sum(p == 0 for p in got.values()) == 180
    for c, keys in sizes.items():
        test = [k for k in by_hash(keys, "42") if got[k] == 0]
        assert test == by_hash(keys, "42")[: len(test)] and abs(len(test) - len(keys) * 0.2) < 1, c


@pytest.mark.parametrize("broadcast", [True, False])
def test_stratified_folds_are_balanced(spark, many_buckets, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sp, "BROADCAST_CLASSES", 1)
    df = classes(spark)
    parts = sp.stratified_kfold(df, "c", ["k"], 5)
    rows = parts.assign(df, "f").collect()
    per_fold = [sum(r["f"] == f for r in rows) for f in range(5)]
    assert sum(per_fold) == 900 and max(per_fold) - min(per_fold) <= 1
    for c in {r["c"] for r in rows}:
        counts = [sum(r["f"] == f and r["c"] == c for r in rows) for f in range(5)]
        assert max(counts) - min(counts) <= 1


def test_split_does_not_depend_on_partitioning(spark):
    df = classes(spark)
    a, b = (sorted(map(tuple, sp.stratified_kfold(df.repartition(n), "c", ["k"], 3).assign(df.repartition(n), "f").collect()))
            for n in (1, 17))
    assert a == b


def test_keys_of_several_columns_stay_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a\\", "b"), ("a", "\\b"), ("\\0", "a"), ("a", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(sp.row_key(["x", "y"])).distinct().count() == len(rows)


# -- metrics -----------------------------------------------------------------------------------------------
def predictions(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, prediction double")


def test_regression_metrics(spark):
    m = met.regression_metrics(predictions(spark, [0, 1, 2, 4], [0.5, 1, 2, 3])).first()
    y, p = np.array([0, 1, 2, 4.0]), np.array([0.5, 1, 2, 3])
    assert m["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["rmse"] == pytest.approx(math.sqrt(((y - p) ** 2).mean())) and m["mae"] == pytest.approx(0.375)
    assert m["mape_pct"] == pytest.approx(np.mean([0, 0, 0.25]) * 100)


def test_regression_metrics_of_a_constant(spark):
    assert met.regression_metrics(predictions(spark, [2, 2], [2, 2])).first()["r2"] == 1.0
    assert met.regression_metrics(predictions(spark, [2, 2], [2, 3])).first()["r2"] == 0.0
    assert met.regression_metrics(predictions(spark, [0, 0], [1, 1])).first()["mape_pct"] is None


def test_classification_metrics_with_absent_classes(spark):
    m = met.classification_metrics(met.confusion_counts(predictions(spark, [0, 0, 1, 1, 2], [0, 1, 1, 1, 3]))).first()
    assert m["accuracy"] == pytest.approx(0.6) and m["recall_weighted"] == pytest.approx(0.6)
    assert m["precision_weighted"] == pytest.approx((1.0 * 2 + 2 / 3 * 2 + 0) / 5)
    assert m["f1_weighted"] == pytest.approx((2 / 3 * 2 + 0.8 * 2 + 0) / 5)
    cells = met.confusion_matrix(predictions(spark, [0, 2], [0, 3])).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == 2


def test_improvement(spark):
    row = spark.range(1).select(
        met.improvement_pct(F.lit(2.0), F.lit(1.0), higher_is_better=False), met.improvement_pct(F.lit(0.5), F.lit(0.6), higher_is_better=True),
        met.improvement_pct(F.lit(0.0), F.lit(1.0), higher_is_better=True)).first()
    assert list(row) == pytest.approx([50.0, 20.0, 0.0])


def brute_auc(score, pos):
    s, p = np.asarray(score), np.asarray(pos, dtype=bool)
    a, b = s[p][:, None], s[~p][None, :]
    return ((a > b).sum() + 0.5 * (a == b).sum()) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("bucket_rows", [3, 1000])
@pytest.mark.parametrize("distinct", [2, 10, 400])
def test_auc_and_curve(spark, bucket_rows, distinct):
    rng = np.random.default_rng(5)
    score = rng.integers(0, distinct, 400) / distinct
    pos = rng.random(400) < 0.3 + 0.4 * score
    df = spark.createDataFrame(list(zip(score.tolist(), pos.tolist())), "score double, positive boolean").repartition(3)
    assert met.roc_auc(df, bucket_rows=bucket_rows).first()["auc"] == pytest.approx(brute_auc(score, pos))
    points = sorted((r["fpr"], r["tpr"]) for r in met.roc_curve(df, bucket_rows=bucket_rows).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == pytest.approx((1.0, 1.0))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(brute_auc(score, pos))


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, True)], "score double, positive boolean")
    assert met.roc_auc(df).first()["auc"] is None


@pytest.mark.parametrize("bucket_rows", [4, 1000])
def test_auc_of_many_classes(spark, bucket_rows):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 150)
    p = rng.dirichlet([1, 1, 1], 150).round(2)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, p)], "y double, probability array<double>")
    want = sum(brute_auc(p[:, c], y == c) * (y == c).sum() for c in range(3)) / 150
    assert met.auc_ovr(df, bucket_rows=bucket_rows).first()["auc"] == pytest.approx(want)


# -- neighbours ----------------------------------------------------------------------------------------------
def brute_neighbours(q, t, tid, k):
    out = []
    for row in q:
        d2 = sum((row[j] - t[:, j]) ** 2 for j in range(t.shape[1]))
        out.append([tid[i] for i in sorted(range(len(t)), key=lambda i: (d2[i], tid[i]))[:k]])
    return out


@pytest.mark.parametrize("block_rows", [7, 40, 10_000])
@pytest.mark.parametrize("k, n", [(5, 300), (3, 2)])
def test_neighbours(spark, block_rows, k, n):
    rng = np.random.default_rng(8)
    train, queries = rng.normal(size=(n, 3)), rng.normal(size=(60, 3)) * 2
    train[: n // 3] = train[0]  # a third of the points coincide
    tid = [f"t{i:04d}" for i in range(n)]
    t = spark.createDataFrame([(a, v.tolist(), float(i)) for i, (a, v) in enumerate(zip(tid, train))], "tid string, v array<double>, y double")
    q = spark.createDataFrame([(f"q{i:03d}", v.tolist()) for i, v in enumerate(queries)], "qid string, v array<double>")
    rows = knn.nearest(q.repartition(3), t.repartition(4), k, block_rows=block_rows).orderBy("qid", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append(r["tid"])
    assert [got[f"q{i:03d}"] for i in range(60)] == brute_neighbours(queries, train, tid, k)


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_are_the_same_in_boxes(k):
    rng = np.random.default_rng(3)
    known, asked = rng.integers(0, 6, size=(700, 3)) / 2, rng.integers(-1, 7, size=(300, 3)) / 2  # many equal distances
    asked[7, 1] = np.nan
    row, col, d2 = knn.closest(asked, known, k)
    every = ((asked[:, None] - known[None]) ** 2).sum(axis=2)
    want = [(i, j, every[i, j]) for i in range(300) if i != 7 for j in np.lexsort((np.arange(700), every[i]))[:k]]
    assert list(zip(row, col, d2)) == want
    known[3, 0] = np.inf
    row, col, _ = knn.closest(asked[:5], known, k)
    assert len(row) == 5 * k and 3 not in col


def test_neighbours_compare_few_pairs(spark, monkeypatch):
    """Four times the points on either side take about four times the pairs, not sixteen."""
    plain, pairs = knn._squared, []
    monkeypatch.setattr(knn, "_squared", lambda a, b: pairs.append(len(a) * len(b)) or plain(a, b))
    seen = []
    for n in (2_000, 8_000):
        points = np.random.default_rng(n).normal(size=(n, 2))
        pairs.clear()
        knn.closest(points, points, 5)
        seen.append(sum(pairs))
    assert seen[1] < 6 * seen[0] and seen[1] < 0.1 * 8_000 ** 2


def test_votes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 2.0), ("b", 0.0)], "qid string, y double")
    got = {r["qid"]: (r["prediction"], list(r["probability"])) for r in knn.vote_of_neighbours(df, 3).collect()}
    assert got["a"] == (1.0, pytest.approx([1 / 3, 2 / 3, 0])) and got["b"] == (0.0, [0.5, 0.0, 0.5])


def test_parts_without_rows_and_many_classes(spark, monkeypatch):
    rows = [(i, f"c{i % 40}") for i in range(97)]
    df = spark.createDataFrame(rows, "id int, c string")
    found = []
    for ordered in (1_000, 5):
        monkeypatch.setattr(sp, "ORDERED_CLASSES", ordered)
        folds = sp.stratified_kfold(df, "c", ["id"], 5)
        tests = sp.stratified_holdout(df, "c", ["id"])
        fold = {r["id"]: r["fold"] for r in folds.assign(df, "fold").collect()}
        part = {r["id"]: r["part"] for r in tests.assign(df, "part").collect()}
        assert sorted(np.bincount(list(fold.values()))) == [19, 19, 19, 20, 20] and sum(p == 0 for p in part.values()) == 20
        for c in range(40):
            mine = [fold[i] for i, name in rows if name == f"c{c}"]
            assert max(np.bincount(mine)) == 1  # two or three rows, each in a fold of its own
        found.append((fold, part))
    assert found[0] == found[1]


def test_many_classes_are_not_put_in_order_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(sp, "ORDERED_CLASSES", 5)
    sizes = sp.class_sizes(spark.range(100).select(F.col("id").cast("string").alias("c")), "c")
    plan = sp._before(sizes, 100, [F.col("_class")], F.col("n"), "start")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_class" not in plan.replace("#", "").replace(" ", "")


def test_confusion_of_many_classes_has_no_grid(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("y"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(0).alias("prediction"))
    cells = met.confusion_matrix(rows, shown=10)
    assert cells.count() == n + 100 - 10 and cells.agg(F.sum("n")).first()[0] == n  # the grid of ten classes has ten full cells
