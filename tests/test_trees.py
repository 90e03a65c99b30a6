"""Trees grown by sums over all rows against trees grown node by node in one process."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import boosting, extra_trees, models, tree_sums


def frame(spark, x, y, partitions=3):
    df = spark.createDataFrame([(int(i), float(t), [float(v) for v in row]) for i, (row, t) in enumerate(zip(x, y))], "_id long, y double, f array<double>")
    return df.select("_id", "y", array_to_vector("f").alias("features")).repartition(partitions)


def plain_forest(x, y, *, n_trees, max_depth, n_tried, n_classes, seed):
    """Node by node: the same draws, every cut scored from the node's own rows. A tree is {path: (feature, cut) or value}."""
    n_features, forest = x.shape[1], []

    def impurity(t):
        if n_classes:
            return len(t) - sum((t == c).sum() ** 2 for c in range(n_classes)) / max(1, len(t))
        return ((t - t.mean()) ** 2).sum() if len(t) else 0.0

    for tree in range(n_trees):
        grown, level = {}, [("", np.arange(len(y)))]
        for depth in range(max_depth + 1):
            open_ = []
            for path, rows in level:
                t = y[rows]
                grown[path] = [float((t == c).mean()) for c in range(n_classes)] if n_classes else [float(t.mean())]
                if len(rows) >= 2 and len(set(t)) > 1 and depth < max_depth:
                    open_.append((path, rows))
            level = []
            if not open_:
                break
            order, place = extra_trees.draws(seed, tree, depth, len(open_), n_features)
            for k, (path, rows) in enumerate(open_):
                xs = x[rows]
                tried = [f for f in np.argsort(order[k]) if xs[:, f].max() > xs[:, f].min()][:n_tried]
                found = []
                for f in tried:
                    low, high = xs[:, f].min(), xs[:, f].max()
                    cut = low + place[k, f] * (high - low)
                    below = xs[:, f] <= cut
                    found.append((impurity(y[rows]) - impurity(y[rows][below]) - impurity(y[rows][~below]), f, cut, below))
                if not found:
                    continue
                top = max(g[0] for g in found)
                _, f, cut, below = next(g for g in found if g[0] >= top - 1e-9 * abs(top) - 1e-12 * ((y[rows] - y.mean()) ** 2).sum())
                grown[path] = (int(f), float(cut))
                level += [(path + "l", rows[below]), (path + "r", rows[~below])]
        forest.append(grown)
    return forest


def walk(trees, tree):
    out, todo = {}, [("", trees.root[tree])]
    while todo:
        path, node = todo.pop()
        if trees.feature[node] < 0:
            out[path] = trees.value[node].tolist()
        else:
            out[path] = (int(trees.feature[node]), float(trees.cut[node]))
            todo += [(path + "l", trees.left[node]), (path + "r", trees.left[node] + 1)]
    return out


def table(n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 3, n), rng.normal(size=n) * 100, np.full(n, 7.0), rng.random(n)], axis=1)
    return x, 3 * x[:, 0] + (x[:, 1] == 2) * 5 + rng.normal(size=n) * 0.1


@pytest.mark.parametrize("n_classes, n_tried, depth", [(0, None, 6), (3, 2, 12)])
def test_extra_trees_agree_node_by_node(spark, monkeypatch, n_classes, n_tried, depth):
    x, y = table()
    if n_classes:
        y = np.digitize(y, [-1.0, 2.0]).astype(float)
    monkeypatch.setattr(tree_sums, "LIMIT", 200)  # several passes a level
    monkeypatch.setattr(tree_sums, "BLOCK", 40)
    model = extra_trees.fit(frame(spark, x, y), n_trees=4, max_depth=depth, n_tried=n_tried, n_classes=n_classes, seed=11)
    want = plain_forest(x, y, n_trees=4, max_depth=depth, n_tried=n_tried or 5, n_classes=n_classes, seed=11)
    for tree, grown in enumerate(want):
        got = walk(model.trees, tree)
        assert got.keys() == grown.keys()
        for path, node in grown.items():
            assert isinstance(node, tuple) == isinstance(got[path], tuple)
            assert np.allclose(got[path], node, rtol=1e-9, atol=1e-9)
    assert model.importances()[3] == 0 and abs(sum(model.importances()) - 1) < 1e-9


def test_extra_trees_predict_and_do_not_depend_on_partitions(spark):
    x, y = table(400, 5)
    one = extra_trees.fit(frame(spark, x, y, 1), n_trees=8, max_depth=12, n_tried=None, seed=3)
    more = extra_trees.fit(frame(spark, x, y, 7), n_trees=8, max_depth=12, n_tried=None, seed=3)
    assert (one.trees.feature == more.trees.feature).all() and np.allclose(one.trees.cut, more.trees.cut)
    got = {r["_id"]: r["prediction"] for r in one.predict(frame(spark, x, y)).collect()}
    assert np.corrcoef([got[i] for i in range(400)], y)[0, 1] > 0.98
    classes = np.digitize(y, [-1.0, 2.0])
    model = extra_trees.fit(frame(spark, x, classes), n_trees=8, max_depth=12, n_tried=2, n_classes=3, seed=3)
    rows = model.predict(frame(spark, x, classes)).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == np.argmax(r["probability"]) for r in rows)
    assert np.mean([r["prediction"] == r["y"] for r in rows]) > 0.95


def test_extra_trees_of_nothing_to_split(spark):
    same = extra_trees.fit(frame(spark, np.ones((5, 2)), [1.0, 2, 3, 4, 5]), n_trees=2, max_depth=4, n_tried=None)
    assert {r["prediction"] for r in same.predict(frame(spark, np.ones((2, 2)), [0, 0])).collect()} == {3.0}
    assert same.predict(frame(spark, np.ones((2, 2)), [0, 0]).where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        extra_trees.fit(frame(spark, np.ones((2, 2)), [0, 0]).where(F.lit(False)), n_trees=2, max_depth=4, n_tried=None)


def plain_boosting(x, y, s, n_classes):
    """The same trees by looking at every value as a cut, node by node, best gain first."""
    n, edges = len(y), [np.unique(c[~np.isnan(c)])[:-1] for c in x.T]
    if n_classes:
        share = np.log(np.bincount(y.astype(int), minlength=n_classes) / n)
        base = share[1:] - share[:1] if n_classes == 2 else share
    else:
        base = np.array([y.mean()])
    margin, losses = np.tile(base, (n, 1)).astype(float), []
    for _ in range(s.rounds):
        g, h = boosting.gradients(y, margin, n_classes)
        step = np.zeros_like(margin)
        for k in range(len(base)):
            def best(rows, depth):
                found = (1e-9, None)
                if depth == s.max_depth:
                    return found
                G, H = g[rows, k].sum(), h[rows, k].sum()
                for f in range(x.shape[1]):
                    for cut in edges[f]:
                        for nan_left in (False, True):
                            v = x[rows, f]
                            low = np.where(np.isnan(v), nan_left, v <= cut)
                            a, b = rows[low], rows[~low]
                            if min(len(a), len(b)) < s.least_rows or min(h[a, k].sum(), h[b, k].sum()) < boosting.LEAST_HESSIAN:
                                continue
                            gain = g[a, k].sum() ** 2 / h[a, k].sum() + g[b, k].sum() ** 2 / h[b, k].sum() - G * G / H
                            if gain > found[0] * (1 + 1e-9):
                                found = (gain, (a, b))
                return found
            leaves = [(np.arange(n), 0, best(np.arange(n), 0))]
            while len(leaves) < s.max_leaves:
                at = max(range(len(leaves)), key=lambda i: leaves[i][2][0] if leaves[i][2][1] else -1)
                rows, depth, (gain, parts) = leaves[at]
                if parts is None:
                    break
                leaves[at:at + 1] = [(r, depth + 1, best(r, depth + 1)) for r in parts]
            for rows, _, _ in leaves:
                step[rows, k] = -g[rows, k].sum() / h[rows, k].sum()
        margin = margin + s.step * step
        if n_classes:
            losses.append(-np.log(boosting.chances(margin)[np.arange(n), y.astype(int)]).mean())
    return margin, losses


@pytest.mark.parametrize("n_classes, leaves", [(0, 5), (2, 8), (3, 4)])
def test_boosting_agrees_with_every_cut_tried(spark, monkeypatch, n_classes, leaves):
    monkeypatch.setattr(boosting, "STAGED", 2)
    x, y = table(90, 2)
    x[::7, 0] = np.nan
    y = y + np.where(np.isnan(x[:, 0]), 4.0, 0.0)
    if n_classes:
        y = np.digitize(y, [-1.0, 2.5][:n_classes - 1]).astype(float)
    y = np.where(np.isnan(y), 6.0, y)
    s = boosting.Settings(rounds=5, step=0.3, max_depth=3, max_leaves=leaves, bins=255, least_rows=4)
    model = boosting.fit(frame(spark, x, y), s, n_classes=n_classes)
    want, losses = plain_boosting(x, y, s, n_classes)
    assert np.allclose(model.margins(x), want, rtol=1e-6, atol=1e-8)
    assert all(a > b for a, b in zip(losses, losses[1:]))
    rows = model.predict(frame(spark, x, y)).orderBy("_id").collect()
    if n_classes:
        assert np.allclose([r["probability"] for r in rows], boosting.chances(want), atol=1e-6)
        assert [r["prediction"] for r in rows] == boosting.chances(want).argmax(axis=1).tolist()
    else:
        assert np.allclose([r["prediction"] for r in rows], want[:, 0], atol=1e-6)


def test_boosting_with_few_bins_and_one_value(spark):
    x, y = table(500, 4)
    model = boosting.fit(frame(spark, x, y), boosting.Settings(rounds=30, bins=16, least_rows=5))
    assert np.corrcoef(model.margins(x)[:, 0], y)[0, 1] > 0.97 and model.importances()[3] == 0
    flat = boosting.fit(frame(spark, x[:20], np.full(20, 2.5)), boosting.Settings(rounds=5))
    assert {r["prediction"] for r in flat.predict(frame(spark, x[:3], y[:3])).collect()} == {2.5}


def test_candidates_carry_their_true_names():
    for task in ("regression", "classification"):
        names = [c.name for c in models.candidates(task, 99)]
        assert {"extra trees", "histogram boosting", "gradient boosting"} <= set(names) and len(set(names)) == len(names)
