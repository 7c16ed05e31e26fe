"""Random trees by levels: all nodes of a level are split together, from counts of bins, by NumPy in tasks that grow a few trees each.

The choices are Spark ML's: bins between quantiles of some 10,000 rows, Poisson weights for each row and tree, the root of the number
of features for each node, Gini impurity, and the mean of the leaves' shares of classes as the forest's vote. A task holds the bins of
one training fold, a byte for each value, which `learn.random_trees_cv` allows up to HELD rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Rows of a training fold, at most, that a task holds.
HELD = 500_000
BINS = 32
#: Rows from which quantiles are taken.
DRAWN = 10_000
#: Cells of counts that are held at a time.
CELLS = 1 << 22
#: Chances of 0, 1, 2, ... draws of a row, added up.
_DRAWS = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)])


def cuts(x: np.ndarray) -> np.ndarray:
    """(features, BINS - 1) bounds between bins: between neighbouring values where they are few, else between quantiles. The rest is infinite."""
    out = np.full((x.shape[1], BINS - 1), np.inf)
    for j in range(x.shape[1]):
        values, n = np.unique(x[:, j], return_counts=True)
        at = np.arange(len(values) - 1)
        if len(values) > BINS:
            at = np.unique(np.clip(np.searchsorted(np.cumsum(n), len(x) * np.arange(1, BINS) / BINS), 0, len(values) - 2))
        out[j, : len(at)] = (values[at] + values[at + 1]) / 2
    return out


def binned(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], 1).astype(np.uint8)


def draws(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row; by the row's hash, so the same wherever the row lies."""
    h = hashes.view(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(_DRAWS, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, "right")


def _gains(left: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Fall of the Gini impurity, times the node's weight, by the counts of classes (the last axis) on the left and in all."""
    right = all_ - left
    nl, nr, n = left.sum(-1), right.sum(-1), all_.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * left).sum(-1) / nl + (right * right).sum(-1) / nr - (all_ * all_).sum(-1) / n
    return np.where((nl >= 1) & (nr >= 1), gain, -1.0)


def _dense(bins: np.ndarray, node: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best gain, feature and bin of each node, from a cell for each bin and class of its features."""
    n, m = features.shape
    code = ((node[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(bins, features[node], 1)) * classes + y[:, None]
    counts = np.bincount(code.ravel(), np.repeat(w, m), n * m * BINS * classes).reshape(n, m, BINS, classes)
    gain = _gains(np.cumsum(counts, 2)[:, :, :-1], counts.sum(2, keepdims=True)).reshape(n, -1)
    best = gain.argmax(1)
    at = np.arange(n)
    return gain[at, best], features[at, best // (BINS - 1)], best % (BINS - 1)


def _sparse(bins: np.ndarray, node: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for nodes of few rows, from the rows in the order of node, feature and bin."""
    n, m = features.shape
    code = ((node[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(bins, features[node], 1)).ravel()
    order = np.argsort(code)
    code, row = code[order], order // m
    one = np.zeros((len(code) + 1, classes))
    one[np.arange(1, len(code) + 1), y[row]] = w[row]
    total = np.cumsum(one, 0)
    group = code // BINS
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))  # of each node and feature
    first = np.concatenate([[0], last[:-1] + 1])
    of = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    ends = np.flatnonzero(np.append((code[1:] != code[:-1]) & (group[1:] == group[:-1]), False))  # of bins with others after them
    gain, feature, cut = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(ends):
        before = total[first[of[ends]]]
        gains = _gains(total[ends + 1] - before, total[last[of[ends]] + 1] - before)
        own = group[ends] // m
        best = np.lexsort((np.arange(len(ends)), -gains, own))
        best = best[np.concatenate([[True], own[best][1:] != own[best][:-1]])]
        gain[own[best]], cut[own[best]] = gains[best], code[ends[best]] % BINS
        feature[own[best]] = features[own[best], group[ends[best]] % m]
    return gain, feature, cut


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tests: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """(tests, classes): the shares of classes in the leaf that each test row comes to, of a tree over rows of weight w."""
    width = bins.shape[1]
    m = max(1, int(np.ceil(np.sqrt(width))))
    node, at = np.zeros(len(bins), np.int64), np.zeros(len(tests), np.int64)  # node of each row and test row that is on its way
    open_rows, open_tests, out, n = np.arange(len(bins)), np.arange(len(tests)), np.zeros((len(tests), classes)), 1
    for level in range(depth + 1):
        counts = np.bincount(node * classes + y[open_rows], w[open_rows], n * classes).reshape(n, classes)
        split = np.zeros(n, bool)
        feature, cut = np.zeros(n, np.int64), np.zeros(n, np.int64)
        wide = np.flatnonzero(counts.max(1) < counts.sum(1)) if level < depth else np.zeros(0, np.int64)
        if len(wide):
            place = np.full(n, -1)
            place[wide] = np.arange(len(wide))
            features = np.argpartition(rng.random((len(wide), width)), m - 1, axis=1)[:, :m] if m < width else np.tile(np.arange(width), (len(wide), 1))
            here = np.flatnonzero(place[node] >= 0)
            here = here[np.argsort(place[node[here]], kind="stable")]
            own = place[node[here]]
            each = m * BINS * classes
            find = _dense if len(wide) * each <= 4 * len(here) * m else _sparse
            step = max(1, CELLS // each) if find is _dense else max(1, len(wide))
            for start in range(0, len(wide), step):
                stop = min(len(wide), start + step)
                lo, hi = np.searchsorted(own, (start, stop))
                rows = open_rows[here[lo:hi]]
                gain, f, c = find(bins[rows], own[lo:hi] - start, y[rows], w[rows], features[start:stop], classes)
                split[wide[start:stop]], feature[wide[start:stop]], cut[wide[start:stop]] = gain > 1e-9, f, c
        shares = counts / np.maximum(counts.sum(1, keepdims=True), 1e-12)
        ended = ~split[at]
        out[open_tests[ended]] = shares[at[ended]]
        child = np.cumsum(split) - 1
        going = split[node]
        open_rows, node = open_rows[going], node[going]
        node = 2 * child[node] + (bins[open_rows, feature[node]] > cut[node])
        open_tests, at = open_tests[~ended], at[~ended]
        at = 2 * child[at] + (tests[open_tests, feature[at]] > cut[at])
        n = 2 * int(split.sum())
        if not n:
            break
    return out


def random_trees_cv(rows: DataFrame, key: str, label: str, trees: int = 200, depth: int = 12, seed: int = 42, fold: str = "fold", vector: str = "z") -> DataFrame:
    """(test_fold, key, actual, predicted) of the rows of every test fold; a task grows a few trees of a fold and lets its test rows down them."""
    kind = {n: rows.schema[n].dataType.simpleString() for n in ("test_fold", key, label)}
    spark = rows.sparkSession
    classes = np.array(sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect()))
    test = F.col(fold) == F.col("test_fold")
    given = rows.where(test | F.col(label).isNotNull()).select("test_fold", F.col(key).alias("key"), F.col(label).alias("actual"), test.alias("test"), F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("z"))
    share = max(1, rows.select(key).distinct().count() // DRAWN)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def bounds(t: pa.Table) -> pa.Table:
        z = t.column("z").combine_chunks()
        found = cuts(z.flatten().to_numpy().reshape(len(t), -1))
        return pa.table({"test_fold": t.column("test_fold").slice(0, 1), "bounds": pa.array([found.tobytes()], pa.binary())})

    some = given.where(~F.col("test") & (F.pmod("h", F.lit(share)) == 0)).select("test_fold", "z")
    of_fold = {r[0]: np.frombuffer(r[1]).reshape(-1, BINS - 1) for r in some.groupBy("test_fold").applyInArrow(bounds, f"test_fold {kind['test_fold']}, bounds binary").collect()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, folds = b.column("z").flatten().to_numpy().reshape(b.num_rows, -1), b.column("test_fold").to_numpy()
            out = np.zeros(x.shape, np.uint8)
            for f in set(folds.tolist()) & set(of_fold):
                out[folds == f] = binned(x[folds == f], of_fold[f])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("test_fold", "key", "actual", "test", "h")), pa.array([r.tobytes() for r in out], pa.binary())], names=["test_fold", "key", "actual", "test", "h", "bins"])

    schema = f"test_fold {kind['test_fold']}, key {kind[key]}, actual {kind[label]}, test boolean, h long, bins binary"
    small = saved(given.mapInArrow(coded, schema))
    parts = min(trees, max(1, -(-6 * spark.sparkContext.defaultParallelism // max(1, len(of_fold)))))

    def grown(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("h")
        tested, h = t.column("test").to_numpy(), t.column("h").to_numpy()
        bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(len(t), -1)
        y = np.searchsorted(classes, t.column("actual").to_pandas().fillna(classes[0]).to_numpy())
        f, part = t.column("test_fold")[0].as_py(), t.column("part")[0].as_py()
        train, tests, votes = bins[~tested], bins[tested], np.zeros((int(tested.sum()), len(classes)))
        for tree in range(part, trees, parts) if len(train) and len(tests) else ():
            w = draws(h[~tested], tree, seed)
            own = np.flatnonzero(w)
            votes += grow(train[own], y[~tested][own], w[own].astype(float), tests, len(classes), depth, np.random.default_rng((seed, int(f), tree)))
        told = t.filter(t.column("test"))
        return pa.table({"test_fold": told.column("test_fold"), "key": told.column("key"), "actual": told.column("actual"), "votes": pa.array(list(votes), pa.list_(pa.float64()))})

    # A few large groups, which their bytes alone would put into one task.
    dealt = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(4 * parts * max(1, len(of_fold)), "test_fold", "part")
    votes = dealt.groupBy("test_fold", "part").applyInArrow(grown, f"test_fold {kind['test_fold']}, key {kind[key]}, actual {kind[label]}, votes array<double>")
    sums = votes.groupBy("test_fold", "key").agg(F.first("actual").alias("actual"), *[F.sum(F.get("votes", F.lit(i))).alias(f"v{i}") for i in range(len(classes))])
    most = F.greatest(*[F.col(f"v{i}") for i in range(len(classes))], F.lit(-1.0), F.lit(-1.0))
    best = F.coalesce(*[F.when(F.round(F.col(f"v{i}"), 9) >= F.round(most, 9), F.lit(c.item())) for i, c in enumerate(classes)], F.lit(None)).cast(kind[label])
    return sums.select("test_fold", F.col("key").alias(key), "actual", best.alias("predicted"))
