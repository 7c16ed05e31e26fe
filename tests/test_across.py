"""Nearest neighbours of all folds from rows that are written once: brute force, ties, outliers, copies, texts as keys, folds' scales."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import learn, neighbours
from lumenforge.sources import shared


def brute(x, keys, own, k):
    out = []
    for i in own:
        d = np.round(((x - x[i]) ** 2).sum(1), 6)
        out.append(sorted((v, keys[j]) for j, v in enumerate(d) if j != i)[:k])
    return out


@pytest.mark.parametrize("pairs", [0, 1 << 18])
@pytest.mark.parametrize("kind", ["normal", "copies", "outliers", "far"])
def test_blocks_find_the_nearest_of_all_pairs(monkeypatch, kind, pairs):
    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    monkeypatch.setattr(neighbours, "STRIP", 1 << 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    if kind == "copies":
        x = np.round(x[rng.integers(0, 40, 4000)], 1)
    if kind == "outliers":
        x[::100] *= 1e5
    if kind == "far":  # products in single precision tell nothing
        x = x * 1e-3 + 3000
    keys = rng.permutation(4000) * 3
    order = np.argsort(keys)
    x, keys = x[order], keys[order]
    own = np.arange(0, 4000, 40)
    near = neighbours.Nearest(x[own], 5, np.dtype(int))
    rest = np.setdiff1d(np.arange(4000), own)
    for part in (rest[2500:], rest[:3], rest[3:2500]):
        near.meet(x[part], keys[part], keys[part] % 7)
    for i, r in enumerate(own):
        d = np.round(((x[rest] - x[r]) ** 2).sum(1), 6)
        want = sorted(zip(d, keys[rest], strict=True))[:5]
        assert [k for _, k in want] == near.key[i].tolist() or kind == "far" and np.allclose([v for v, _ in want], near.d[i], atol=2e-6)
        assert (near.label[i] == near.key[i] % 7).all()


def table(spark, n, text=False, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * [1, 50, 0.02], 2)
    keys = [f"é{i * 7 % 1000}" if text else i * 7 for i in range(n)]
    return spark.createDataFrame([(k, int(rng.integers(0, 3)), i % 4, v.tolist()) for i, (k, v) in enumerate(zip(keys, x, strict=True))], f"id {'string' if text else 'long'}, label int, fold int, features array<double>")


@pytest.mark.parametrize("text", [False, True])
def test_same_votes_as_from_standardized_rows(spark, monkeypatch, text):
    monkeypatch.setattr(neighbours, "ACROSS_VALUES", 120)  # several blocks a fold
    rows = table(spark, 300, text).cache()
    want = {tuple(r) for r in learn.knn(learn.standardize(rows), "id", "label").collect()}
    assert {tuple(r) for r in learn.knn_across(rows, "id", "label").collect()} == want and len(want) == 300


def test_few_rows_and_none(spark):
    rows = table(spark, 5)
    want = {tuple(r) for r in learn.knn(learn.standardize(rows), "id", "label").collect()}
    assert {tuple(r) for r in learn.knn_across(rows, "id", "label").collect()} == want
    assert learn.knn_across(rows.limit(0), "id", "label").count() == 0


def test_rows_are_written_once(spark, monkeypatch):
    """Not once for each fold, nor for each cell that may hold a neighbour."""
    wrote, before = [], shared.saved
    monkeypatch.setattr(neighbours, "saved", lambda df: wrote.append(before(df)) or wrote[-1])
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 5).cast("int").alias("fold"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.rand(3) + i).alias("features"))
    found = learn.knn_across(rows, "id", "label")
    assert found.count() == 2000
    vectors = sum(df.count() if "id" in df.columns or "x" in df.columns and df.schema["x"].dataType.simpleString() != "binary" else df.selectExpr("sum(size(keys))").first()[0] for df in wrote)
    assert vectors == 2 * 2000


def test_the_board_leaves_predictions_and_no_vectors(spark):
    from lumenforge.plans import catalogue

    start = shared.written()
    board = catalogue.leaderboard(spark, "/root/testdata/sf0.001")
    left = [spark.read.parquet(p) for p in shared._WRITTEN[start:]]
    assert board.count() == 3 and len(left) == 4
    assert all(df.count() == 500 for df in left) and sum("array" in kind for df in left for _, kind in df.dtypes) == 1
