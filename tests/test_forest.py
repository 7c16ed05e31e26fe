"""Random trees grown by levels: splits against enumeration, both ways of counting, predictions, folds that are too large for a task."""

import numpy as np
import pytest

from lumenforge.operators import forest, learn
from test_cascade import data, table


def best_split(bins, y, w, features, classes):
    """The largest fall of Gini impurity by trying each feature and bin."""
    gini = lambda own: 1 - sum((w[own & (y == c)].sum() / w[own].sum()) ** 2 for c in range(classes))
    best, all_ = 0.0, np.ones(len(y), bool)
    for f in features:
        for b in range(forest.BINS - 1):
            left = bins[:, f] <= b
            if left.any() and not left.all():
                best = max(best, gini(all_) * w.sum() - gini(left) * w[left].sum() - gini(~left) * w[~left].sum())
    return best


@pytest.mark.parametrize("find", [forest._dense, forest._sparse])
def test_splits_are_the_best_of_all(find):
    rng = np.random.default_rng(3)
    bins, y, w, node = rng.integers(0, 32, (90, 6)).astype(np.uint8), rng.integers(0, 3, 90), rng.integers(1, 4, 90).astype(float), np.sort(rng.integers(0, 4, 90))
    bins[node == 2] = 7  # nothing to split
    features = np.array([rng.permutation(6)[:3] for _ in range(4)])
    gain, feature, cut = find(bins, node, y, w, features, 3)
    for k in range(4):
        own = node == k
        want = best_split(bins[own], y[own], w[own], features[k], 3)
        assert max(gain[k], 0) == pytest.approx(want, abs=1e-9)
        if want:
            assert feature[k] in features[k] and best_split(np.where(bins[own][:, [feature[k]]] <= cut[k], 0, 1), y[own], w[own], [0], 3) == pytest.approx(want)


def test_a_tree_without_limits_knows_its_own_rows():
    rng = np.random.default_rng(1)
    bins = np.unique(rng.integers(0, 32, (300, 4)).astype(np.uint8), axis=0)
    y = rng.integers(0, 3, len(bins))
    got = forest.grow(bins, y, np.ones(len(bins)), bins, 3, 60, np.random.default_rng(2))
    assert (got.argmax(1) == y).mean() > 0.97 and np.allclose(got.sum(1), 1)
    none = forest.grow(bins, y, np.ones(len(bins)), bins, 3, 0, np.random.default_rng(2))
    assert np.allclose(none, np.bincount(y) / len(y))


def test_draws_are_poisson_and_bins_keep_the_order():
    w = forest.draws(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 200_000), 7, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    x = np.random.default_rng(5).normal(size=(5000, 2))
    x[:, 1] = np.round(x[:, 1])
    got = forest.binned(x, forest.cuts(x))
    assert (np.diff(got[np.argsort(x[:, 0]), 0].astype(int)) >= 0).all() and len(np.unique(got[:, 0])) == 32 and np.bincount(got[:, 0]).max() < 200
    assert len(np.unique(got[:, 1])) == len(np.unique(x[:, 1]))


def test_forest_predicts_each_test_row_as_sparks_does(spark, monkeypatch):
    x, y = data(400)
    rows = table(spark, x * 3, y)
    got = {r.id: (r.test_fold, r.actual, r.predicted) for r in learn.random_trees_cv(rows, "id", "label", trees=40, depth=6).collect()}
    assert {i: v[:2] for i, v in got.items()} == {i: (i % 3, y[i]) for i in range(400)}
    again = {r.id: (r.test_fold, r.actual, r.predicted) for r in learn.random_trees_cv(rows.repartition(3), "id", "label", trees=40, depth=6).collect()}
    assert got == again
    monkeypatch.setattr(forest, "HELD", 10)  # more rows than a task may hold
    theirs = {r.id: r.predicted for r in learn.random_trees_cv(rows, "id", "label", trees=40, depth=6).collect()}
    mine, other = (np.array([p[i] for i in range(400)]) for p in ({i: v[2] for i, v in got.items()}, theirs))
    assert (mine == y).mean() > (other == y).mean() - 0.04 and (mine == other).mean() > 0.85


def test_no_job_for_each_level_and_node(spark, monkeypatch):
    monkeypatch.setattr(learn, "random_trees", lambda *a, **k: pytest.fail("a fold was fitted by jobs"))
    x, y = data(60)
    assert learn.random_trees_cv(table(spark, x, y), "id", "label", trees=5, depth=3).count() == 60
    assert learn.random_trees_cv(table(spark, x, y).limit(0), "id", "label").count() == 0
