"""Exact percentiles of groups of any size, and nearest neighbours over cells: brute force, ties, clusters, empty and null groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import learn, neighbours, quantiles


@pytest.mark.parametrize("few", [4, 2048])
def test_percentiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.normal(size=5000), "same": np.full(900, 2.5), "two": np.array([1.0] * 700 + [9.0] * 300), "one": np.array([4.0]), "pair": np.array([1.0, 2.0]),
        "wide": 10.0 ** rng.uniform(-200, 200, 3000), None: rng.integers(-50, 50, 4000).astype(float), "minus": -np.exp(rng.normal(size=1000) * 5),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {(r.g, r.share): r.percentile for r in quantiles.percentiles(df, ["g"], "v", shares).collect()}
    assert len(got) == len(groups) * len(shares)
    for g, vs in groups.items():
        for p in shares:
            assert got[g, p] == pytest.approx(float(np.quantile(vs, p)), rel=1e-9), (g, p)


def test_percentiles_hold_few_rows_of_a_group(spark, monkeypatch):
    """What is gathered at last is at most FEW of a group's rows."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    rows = spark.range(20_000).select(F.lit("hot").alias("g"), (F.xxhash64("id") % 100_000).cast("double").alias("v"))
    asked = spark.createDataFrame([("hot", 9_999, -1e6, 1e6, 20_000)], "g string, rank long, low double, high double, live long")
    got = quantiles.ranks(rows.withColumnRenamed("v", "value"), ["g"], asked).first().value
    assert got == sorted(r.v for r in rows.collect())[9_999]
    with pytest.raises(ValueError, match="between"):
        quantiles.percentiles(rows, ["g"], "v", (1.5,))
    assert quantiles.percentiles(rows.limit(0), ["g"], "v", (0.5,)).count() == 0


def folds(spark, x: np.ndarray, y: np.ndarray, k: int = 3):
    rows = [(i, int(c), i % k, [float(a) for a in v]) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, label int, fold int, z array<double>")
    return df.crossJoin(spark.range(k).select(F.col("id").cast("int").alias("test_fold")))


def vote(x, y, k_folds=3, k=5):
    out = {}
    fold = np.arange(len(x)) % k_folds
    for f in range(k_folds):
        train = np.flatnonzero(fold != f)
        for i in np.flatnonzero(fold == f):
            d = np.round(((x[train] - x[i]) ** 2).sum(1), 6)
            near = train[np.lexsort((train, d))][:k]
            out[f, int(i)] = min(set(y[near].tolist()), key=lambda c: (-(y[near] == c).sum(), np.flatnonzero(y[near] == c).sum(), c))
    return out


@pytest.mark.parametrize("pivots", [1, 8, 48])
def test_knn_equals_brute_force(spark, pivots):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5)) * 20
    x = np.concatenate([centres[rng.integers(0, 6, 250)] + rng.normal(size=(250, 5)), np.zeros((20, 5)), rng.normal(size=(30, 5)) * 40])
    x = np.round(x, 1)  # ties
    y = rng.integers(0, 4, len(x))
    before, neighbours.PIVOTS = neighbours.PIVOTS, pivots
    try:
        found = neighbours.knn(folds(spark, x, y), "id", "label", pivots=pivots)
        assert found.count() >= 5 * len(x)
        got = {(r.test_fold, r.id): r.predicted for r in learn.knn(folds(spark, x, y), "id", "label").collect()}
    finally:
        neighbours.PIVOTS = before
    assert got == vote(x, y)


def test_clustered_rows_need_few_cells():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 30
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    pivots = x[:48]
    d = neighbours._distances(x, pivots)
    cell, far = d.argmin(1), d.min(1)
    radius = np.array([far[cell == j].max(initial=-1.0) for j in range(48)])
    near = [np.sort(far[cell == j])[:5] for j in range(48)]
    mask = neighbours.needed(x, cell, pivots, radius, near, 5)
    sizes = np.bincount(cell, minlength=48)
    assert (mask * sizes).sum() < 0.25 * len(x) ** 2
    # No cell that holds one of the five nearest is left out.
    for i in range(0, 4000, 40):
        nearest = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:5]
        assert mask[i, cell[nearest]].all()


def test_knn_of_few_rows_and_of_none(spark):
    x, y = np.array([[0.0], [1.0], [2.0]]), np.array([0, 1, 1])
    got = {(r.test_fold, r.id): r.predicted for r in learn.knn(folds(spark, x, y), "id", "label").collect()}
    assert got == vote(x, y)
    assert learn.knn(folds(spark, x, y).limit(0), "id", "label").count() == 0
