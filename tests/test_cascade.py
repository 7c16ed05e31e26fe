"""Exact machines over tables: the optimum of all rows by blocks, predictions, ties, classes of few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import cascade, learn


def table(spark, x, y, k=3):
    rows = [(i, None if c is None else int(c), i % k, [float(a) for a in v]) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, fold int, z array<double>").crossJoin(spark.range(k).select(F.col("id").cast("int").alias("test_fold")))


def data(n: int, seed: int = 1, classes: int = 3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(n, 4)) + 1.3 * np.stack([np.cos(y), np.sin(y), y % 2, y % 3], axis=1), y


def dual(x, y, c, gamma):
    gram = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    w, _ = learn._svm_pair(gram, y, c, 1000, 1e-6)
    return np.abs(w).sum() - 0.5 * w @ gram @ w


@pytest.mark.parametrize("block", [30, 1000])
def test_the_cascade_reaches_the_optimum_of_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(cascade, "BLOCK", block)
    monkeypatch.setattr(cascade, "ADDED", 5)
    x, y = data(270)
    rows = table(spark, x, y)
    found = cascade.machines(rows, "id", "label", c=2.0, gamma=0.2).cache()
    got = {(r.test_fold, r.low, r.high): r.dual for r in cascade.objective(found, 0.2).collect()}
    assert set(got) == {(f, a, b) for f in range(3) for a, b in ((0, 1), (0, 2), (1, 2))}
    for (f, a, b), value in got.items():
        own = np.flatnonzero((np.arange(len(x)) % 3 != f) & ((y == a) | (y == b)))
        best = dual(x[own], np.where(y[own] == a, 1.0, -1.0), 2.0, 0.2)
        assert value == pytest.approx(best, rel=1e-3)
    # No row breaks the conditions.
    for r in found.collect():
        own = np.flatnonzero((np.arange(len(x)) % 3 != r.test_fold) & ((y == r.low) | (y == r.high)))
        v, w = np.array([p.z for p in r.support]), np.array([p.alpha * p.y for p in r.support])
        sign = np.where(y[own] == r.low, 1.0, -1.0)
        margin = sign * cascade.decision(x[own], v, w, r.bias, 0.2)
        inside = {tuple(p.z) for p in r.support}
        assert all(m >= 1 - 2e-3 for m, p in zip(margin, x[own], strict=True) if tuple(p) not in inside)
    predicted = {(r.test_fold, r.id): r.predicted for r in cascade.svm_cv(rows, "id", "label", c=2.0, gamma=0.2).collect()}
    for f in range(3):
        test, train = np.arange(len(x)) % 3 == f, np.arange(len(x)) % 3 != f
        want = learn.svm(x[train], y[train], x[test], 2.0, 0.2)
        same = np.array([predicted[f, int(i)] for i in np.flatnonzero(test)]) == want
        assert same.mean() >= 0.98


def test_separable_classes_null_labels_and_lone_rows(spark):
    x = np.array([[0.0], [0.1], [0.2], [9.0], [9.1], [9.2], [50.0], [3.0]])
    y = [0, 0, 0, 1, 1, 1, 2, None]
    got = cascade.svm_cv(table(spark, x, y), "id", "label", gamma=0.5).collect()
    assert {r.id: r.predicted for r in got if r.actual in (0, 1)} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert {r.id for r in got} == set(range(8))
    assert cascade.svm_cv(table(spark, x, y).limit(0), "id", "label").count() == 0


def test_solve_of_one_class_and_of_equal_rows():
    a, b = cascade.solve(np.zeros((3, 2)), np.ones(3), np.zeros(3), 2.0, 0.1, 1e-4)
    assert not a.any() and np.isfinite(b)
    a, b = cascade.solve(np.zeros((4, 2)), np.array([1.0, 1, -1, -1]), np.zeros(4), 2.0, 0.1, 1e-4)
    assert abs((a * np.array([1, 1, -1, -1])).sum()) < 1e-9 and np.isfinite(b)


def test_query_predicts_each_row_once(spark):
    from lumenforge.plans import catalogue

    rows = catalogue.queries()["svm_cascade"](spark, "/root/testdata/sf0.001").toPandas()
    folds = catalogue._folded(spark, "/root/testdata/sf0.001").toPandas()
    both = rows.merge(folds, on="vec_id")
    assert sorted(rows.vec_id) == sorted(folds.vec_id) and (both.test_fold == both.fold).all() and (both.actual == both.label).all()


def test_multipliers_are_taken_up_without_a_column_each(monkeypatch):
    """A start from known multipliers makes its gradient from strips of the kernel, and ends at once where they are right."""
    x, y = data(300, classes=2)
    y = np.where(y == 0, 1.0, -1.0)
    a, bias = cascade.solve(x, y, np.zeros(300), 2.0, 0.2, 1e-6)
    calls, kernel = [], cascade._kernel
    monkeypatch.setattr(cascade, "_kernel", lambda *args: calls.append(1) or kernel(*args))
    again, same = cascade.solve(x, y, a, 2.0, 0.2, 1e-4)
    assert len(calls) <= 3 and (a > 0).sum() > 20 and (again == a).all() and same == pytest.approx(bias)
    monkeypatch.setattr(cascade, "STRIP", 1)
    assert np.allclose(cascade.solve(x, y, a, 2.0, 0.2, 1e-4)[0], a)
    want = bias + np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2)) @ (a * y)
    assert np.allclose(cascade.decision(x, x, a * y, bias, 0.2), want)


def test_small_groups_are_dealt_to_many_tasks(spark, monkeypatch):
    wrote, before = [], cascade.saved
    monkeypatch.setattr(cascade, "saved", lambda df: wrote.append(df) or before(df))
    x, y = data(270)
    cascade.machines(table(spark, x, y), "id", "label", gamma=0.2)
    assert wrote[1].rdd.mapPartitions(lambda p: [any(True for _ in p)]).sum() >= 5  # of nine machines of one block each
