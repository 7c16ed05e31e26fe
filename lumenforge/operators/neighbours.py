"""Exact nearest neighbours over cells around pivots: a row is compared with the cells alone that may hold one of its k nearest.

Some rows are drawn as pivots; every row belongs to the cell of its nearest one. What is known of cells (radius, the k rows nearest
to the pivot) bounds the k-th distance of a row from above, and the triangle inequality and the planes between pivots bound
its distance to a cell's rows from below. On clustered rows few cells remain; without clusters all do, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import saved

PIVOTS = 48
#: Doubles of a block of rows.
BLOCK_VALUES = 1 << 16


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slack(bound: np.ndarray) -> np.ndarray:
    """Room for rounding: squared distances are told apart to six decimals."""
    return np.sqrt(bound**2 + 1e-5) * (1 + 1e-9) + 1e-9


def needed(x: np.ndarray, own: np.ndarray, pivots: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int) -> np.ndarray:
    """(rows, cells): whether a cell may hold one of a row's k nearest. `own` is a row's cell, `radius` a cell's (negative: empty),
    `near` the distances of the k rows next to its pivot."""
    d, between = _distances(x, pivots), _distances(pivots, pivots)
    reach = np.full(len(pivots), np.inf)
    for i in range(len(pivots)):
        all_ = np.sort(np.concatenate([between[i, j] + v for j, v in enumerate(near)]))
        if len(all_) >= k:
            reach[i] = all_[k - 1]
    to_own = d[np.arange(len(x)), own]
    most = _slack(to_own + reach[own])
    with np.errstate(divide="ignore", invalid="ignore"):
        planes = (d**2 - to_own[:, None] ** 2) / (2 * between[own])
    least = np.maximum(d - radius[None, :], np.where(between[own] > 0, planes, 0))
    return (least <= most[:, None]) & (radius >= 0)[None, :]


def cells(rows: DataFrame, key: str, vector: str, by: str, test, pivots: int) -> dict:
    """Pivots of each value of `by`: the rows of least hash that are no test rows. A few vectors, by the parameter."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64(key), key))
    # A hash's low share of a large table is enough to draw from, so a window sees a few rows alone.
    share = max(1, rows.count() // (1000 * pivots))
    drawn = rows.where(~test & (F.pmod(F.xxhash64(key), F.lit(share)) == 0)).withColumn("place", place).where(F.col("place") <= pivots)
    out: dict = {}
    for r in drawn.select(by, vector).toLocalIterator():
        out.setdefault(r[0], []).append(r[1])
    return {k: np.unique(np.array(v, float), axis=0) for k, v in out.items()}


def knn(rows: DataFrame, key: str, label: str, k: int = 5, fold: str = "fold", vector: str = "z", block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(test_fold, key, actual, other, vote, d) of the k nearest training rows of each test row, equals by their key. Rows as
    `learn.standardize` gives them.

    Test rows and the rows of a cell are dealt into blocks of about `block` rows, by default BLOCK_VALUES numbers; a task compares two blocks at a time and
    lets only the k nearest of each test row go on."""
    spark = rows.sparkSession
    here = F.col(fold) == F.col("test_fold")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("test_fold", key, label)}
    plain = saved(rows.select("test_fold", key, F.col(label).alias("label"), here.alias("test"), F.col(vector).cast("array<double>").alias("vector")))
    drawn = cells(plain, key, "vector", "test_fold", F.col("test"), pivots)
    width = max((p.shape[1] for p in drawn.values()), default=1)
    block = block or max(16, BLOCK_VALUES // width)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's cell and its distance from the pivot; folds without pivots have no training rows."""
        for b in batches:
            x, folds = _matrix(b.column("vector")), b.column("test_fold").to_pylist()
            cell, far = np.full(len(x), -1), np.zeros(len(x))
            for f in set(folds) & set(drawn):
                at = np.flatnonzero([g == f for g in folds])
                d = _distances(x[at], drawn[f])
                cell[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    shape = f"test_fold {kinds['test_fold']}, `{key}` {kinds[key]}, label {kinds[label]}, test boolean, vector array<double>"
    own = saved(plain.mapInArrow(placed, f"{shape}, cell int, far double"))
    train = own.where("not test")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell, in a task: rows, radius, the k least distances."""
        held: dict = {}
        for b in batches:
            for f, c, d in zip(*(b.column(n).to_pylist() for n in ("test_fold", "cell", "far")), strict=True):
                n, r, some = held.get((f, c), (0, 0.0, []))
                some = sorted([*some, d])[:k] if len(some) < k or d < some[-1] else some
                held[f, c] = (n + 1, max(r, d), some)
        if held:
            kind = pa.schema([b.schema.field("test_fold")]).field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], kind), pa.array([c for _, c in held], pa.int32()), *(pa.array([v[i] for v in held.values()]) for i in range(3))], names=["test_fold", "cell", "n", "radius", "near"])

    parts = train.select("test_fold", "cell", "far").mapInArrow(summed, f"test_fold {kinds['test_fold']}, cell int, n long, radius double, near array<double>")
    about: dict = {f: (np.full(len(p), -1.0), [np.zeros(0)] * len(p)) for f, p in drawn.items()}
    for r in parts.groupBy("test_fold", "cell").agg(F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")).toLocalIterator():
        about[r.test_fold][0][r.cell] = r.radius
        about[r.test_fold][1][r.cell] = np.array(r.near)

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Test rows with the cells they need."""
        for b in batches:
            out = [[] for _ in range(len(b))]
            for f in set(b["test_fold"]) & set(drawn):
                at = np.flatnonzero((b["test_fold"] == f).to_numpy())
                mask = needed(np.stack(b["vector"].iloc[at].to_list()), b["cell"].to_numpy()[at], drawn[f], *about[f], k)
                for i, row in zip(at, mask, strict=True):
                    out[i] = np.flatnonzero(row).tolist()
            yield b.drop(columns=["cell"]).assign(cells=out)

    tests = own.where("test").select("test_fold", key, "label", "vector", "cell").mapInPandas(asks, f"test_fold {kinds['test_fold']}, `{key}` {kinds[key]}, label {kinds[label]}, vector array<double>, cells array<int>")
    asked = saved(tests.select("test_fold", key, "label", "vector", F.explode("cells").alias("cell")))

    def packed(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy("test_fold", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))  # a row for each cell of a fold
        dealt = df.join(F.broadcast(sizes), ["test_fold", "cell"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
        return dealt.groupBy("test_fold", "cell", "block").agg(F.collect_list(F.struct(F.col(key).alias("key"), "label", "vector")).alias(name)).drop("block")

    both = packed(asked, "a").join(packed(train, "b"), ["test_fold", "cell"]).drop("cell")
    names = ["test_fold", key, "actual", "other", "vote", "d"]

    def nearest_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, a, b in zip(*batch.columns, strict=True):
                (ka, la, x), (kb, lb, y) = _unpacked(a.values), _unpacked(b.values)
                d = np.round((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 6)
                order = np.argsort(np.maximum(d, 0), axis=1, kind="stable")[:, :k]  # equals in the order of their keys
                m = order.shape[1]
                at, near = np.repeat(np.arange(len(x)), m), order.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([f.as_py()] * len(at), f.type), ka.take(pa.array(at)), la.take(pa.array(at)), kb.take(pa.array(near)), lb.take(pa.array(near)), pa.array(np.maximum(d[at, near], 0))], names=names)

    return both.mapInArrow(nearest_of_block, f"test_fold {kinds['test_fold']}, `{key}` {kinds[key]}, actual {kinds[label]}, other {kinds[key]}, vote {kinds[label]}, d double")


def _unpacked(block: pa.StructArray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Keys, labels and the matrix of a block, in the order of the keys."""
    block = block.take(pc.sort_indices(block.field("key")))
    vectors = block.field("vector")
    return block.field("key"), block.field("label"), vectors.flatten().to_numpy().reshape(len(block), -1)


# Rows once, each fold with its own scale


#: Rows of a block, at most, by the numbers that it holds.
ACROSS_VALUES = 1 << 19
#: Numbers of a strip of products.
STRIP = 1 << 22
#: Pairs of a strip that are looked at one by one; beyond that the strip is compared whole.
PAIRS = 1 << 18


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least of each row, of equals the first columns."""
    if d.shape[1] > k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        same = d == kth
        d = (d < kth) | same & (np.cumsum(same, 1) <= k - (d < kth).sum(1, keepdims=True))
        return np.nonzero(d)
    return np.nonzero(np.ones(d.shape, bool))


class Nearest:
    """The k nearest of a block's rows among all blocks that it has met, equals by their key."""

    def __init__(self, x: np.ndarray, k: int, kind: np.dtype):
        self.x, self.k, self.square = x, k, (x * x).sum(1)
        self.near = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
        self.d, self.label = np.full((len(x), k), np.inf), np.zeros((len(x), k), kind)
        self.key: np.ndarray | None = None

    def meet(self, y: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        """Compares all pairs; keys ascend. Products in single precision leave out the pairs that are surely too far, by a bound of
        their error; what is left is told exactly."""
        if self.key is None:
            self.key = np.full(self.d.shape, keys[0], keys.dtype)
        elif keys.dtype != self.key.dtype:  # longer texts
            self.key = self.key.astype(np.promote_types(keys.dtype, self.key.dtype))
        square = (y * y).sum(1)
        if np.isinf(self.d[:, -1]).any():  # a first bound
            few = min(len(y), 1024)
            for start in range(0, len(self.x), 256):
                self._whole(np.arange(start, min(start + 256, len(self.x))), y[:few], square[:few], keys[:few], labels[:few])
            y, square, keys, labels = y[few:], square[few:], keys[few:], labels[few:]
        if not len(y):
            return
        other = np.ascontiguousarray(np.hstack([y, -square[:, None] / 2]).astype(np.float32).T)
        longest = np.sqrt(square.max())
        step = max(1, STRIP // len(y))
        product, mask = np.empty((step, len(y)), np.float32), np.empty((step, len(y)), bool)
        for start in range(0, len(self.x), step):
            at = slice(start, min(start + step, len(self.x)))
            n = at.stop - start
            size = np.sqrt(self.square[at])
            error = (other.shape[0] + 8) * 2.0**-23 * (size * longest + longest**2 / 2 + 1)
            bound = ((self.square[at] - self.d[at, -1] - 2e-6) / 2 - error).astype(np.float32)
            np.dot(self.near[at], other, out=product[:n])
            np.greater_equal(product[:n], np.nextafter(bound, np.float32(-np.inf))[:, None], out=mask[:n])
            found = np.flatnonzero(mask[:n])
            if len(found) > PAIRS:
                for s in range(start, at.stop, max(1, STRIP // 8 // len(y))):
                    self._whole(np.arange(s, min(s + max(1, STRIP // 8 // len(y)), at.stop)), y, square, keys, labels)
                continue
            rows, cols = found // len(y) + start, found % len(y)
            d = np.empty(len(found))
            for s in range(0, len(found), 1 << 15):
                gap = self.x[rows[s : s + (1 << 15)]] - y[cols[s : s + (1 << 15)]]
                d[s : s + (1 << 15)] = np.round((gap * gap).sum(1), 6)
            kept = d <= self.d[rows, -1]
            self._join(rows[kept], d[kept], keys[cols[kept]], labels[cols[kept]])

    def _whole(self, part: np.ndarray, y: np.ndarray, square: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        d = np.maximum(np.round(self.square[part][:, None] + square[None, :] - 2 * self.x[part] @ y.T, 6), 0)
        rows, cols = _least(d, self.k)
        self._join(part[rows], d[rows, cols], keys[cols], labels[cols])

    def _join(self, rows: np.ndarray, d: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        if not len(rows):
            return
        own = np.unique(rows)
        rows, d = np.concatenate([np.repeat(own, self.k), rows]), np.concatenate([self.d[own].ravel(), d])
        keys, labels = np.concatenate([self.key[own].ravel(), keys]), np.concatenate([self.label[own].ravel(), labels])
        order = np.lexsort((keys, d, rows))
        first = np.searchsorted(rows[order], own)
        best = order[first[:, None] + np.arange(self.k)]
        self.d[own], self.key[own], self.label[own] = d[best], keys[best], labels[best]


def _plain(column: pa.Array) -> np.ndarray:
    """Keys or labels; texts as NumPy's own, which sort like UTF-8."""
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def across(rows: DataFrame, key: str, label: str, stats: dict, k: int = 5, fold: str = "fold", features: str = "features") -> DataFrame:
    """(test_fold, key, actual, other, vote, d) of the k nearest rows of the other folds, for each row of each fold, on features scaled by
    the fold's `stats` (mean, deviation). All pairs are compared, but a row is written once, in a block of its fold, and each task
    lets all blocks pass by a few blocks of its own: nothing is sent once for each fold, cell or pair."""
    spark = rows.sparkSession
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (fold, key, label)}
    single = rows.schema[features].dataType.simpleString() == "array<float>"
    kind, width = np.dtype(np.float32 if single else np.float64), max((len(m) for m, _ in stats.values()), default=1)
    plain = saved(rows.select(F.col(fold).alias("fold"), F.col(key).alias("key"), F.col(label).alias("label"), F.col(features) if single else F.col(features).cast("array<double>")).toDF("fold", "key", "label", "x"))
    n, cores = plain.count(), spark.sparkContext.defaultParallelism
    size = max(16, min(ACROSS_VALUES // width, -(-n // (4 * cores))))
    sizes = plain.groupBy("fold").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))  # a row for each fold

    def packed(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("key")
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        one = lambda c: pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type))
        return pa.table({"fold": t.column("fold").slice(0, 1), "block": t.column("block").slice(0, 1), "keys": one("key"), "labels": one("label"), "x": pa.array([x.tobytes()], pa.binary())})

    dealt = plain.join(F.broadcast(sizes), "fold").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = saved(dealt.groupBy("fold", "block").applyInArrow(packed, f"fold {kinds[fold]}, block int, keys array<{kinds[key]}>, labels array<{kinds[label]}>, x binary"))
    count = blocks.count()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                f, b = batch.column("fold")[i].as_py(), batch.column("block")[i].as_py()
                m, sd = stats[f]
                scaled = lambda c, i=i, batch=batch: (np.frombuffer(batch.column(c)[i].as_buffer(), kind).reshape(-1, width).astype(float) - m) / sd  # noqa: E731, B023
                if (f, b) not in held:
                    own = batch.column("labels")[i].values
                    held[f, b] = (Nearest(scaled("x"), k, own.to_numpy(zero_copy_only=False).dtype), batch.column("keys")[i].values, own, batch.column("fold").slice(i, 1))
                held[f, b][0].meet(scaled("y"), _plain(batch.column("others")[i].values), batch.column("votes")[i].values.to_numpy(zero_copy_only=False))
        for near, keys, labels, at in held.values():
            rows_, cols = np.nonzero(np.isfinite(near.d))
            for s in range(0, len(rows_), 100_000):
                r, c = rows_[s : s + 100_000], cols[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([at.take(pa.array(np.zeros(len(r), np.int64))), keys.take(pa.array(r)), labels.take(pa.array(r)), pa.array(near.key[r, c]).cast(keys.type), pa.array(near.label[r, c]).cast(labels.type), pa.array(near.d[r, c])], names=["test_fold", key, "actual", "other", "vote", "d"])

    # The blocks of one side pass in a single row of tasks' partitions, each task reading them all; those of the other are spread.
    passing = blocks.select(F.col("fold").alias("from"), F.col("keys").alias("others"), F.col("labels").alias("votes"), F.col("x").alias("y")).coalesce(1)
    pairs = passing.crossJoin(blocks.repartition(max(1, count), "fold", "block")).where(F.col("from") != F.col("fold"))
    return pairs.select("fold", "block", "keys", "labels", "x", "others", "votes", "y").mapInArrow(met, f"test_fold {kinds[fold]}, `{key}` {kinds[key]}, actual {kinds[label]}, other {kinds[key]}, vote {kinds[label]}, d double")
