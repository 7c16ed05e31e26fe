"""Whitening of embeddings by exact integer sums.

An entry c becomes the integer x = floor(64 c) + 1000000. Products of such integers are summed exactly by matrix products of
doubles: integers are split into limbs of `LIMB` bits with signs, so small that a product of two limb matrices over a block of
`BLOCK` rows stays below 2^53, where doubles hold every integer. Each task carries its blocks' products into digits of LIMB
bits, Spark adds the digits up, and the driver recombines them as big integers: one for each pair of dimensions, however many
rows there are. Rows carry a leading 1, so the same products hold the count and the sums. The covariance is an exact fraction,
rounded once to doubles; its unit eigenvectors and eigenvalues make the projection.

Rows whose vector is null, or has null or non-finite entries, are dropped. So are rows whose vector has another length than
most of the remaining ones have (of equally frequent lengths, than the largest). Beyond 2^62, floor(64 c) is held at 2^62.
Components without variance (eigenvalues that are nothing but rounding) have null values, and are left out of the identity's
error. An exact deviation beyond a long is null. Repeated rows count as often as they come; an empty table gives no rows;
further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 20
BLOCK = 4096
#: Digits that hold a sum of products: products of four limbs each have seven places, the rest is for carries.
PLACES = 9
COMPONENTS = 32


def as_integers(vectors: np.ndarray) -> np.ndarray:
    """x of each entry."""
    return np.clip(np.floor(64 * vectors.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64) + 1_000_000


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of integers, the lowest first, as doubles; high ones that are all 0 are left out."""
    out, half = [], 1 << (LIMB - 1)
    while x.any():
        low = ((x + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB
    return out


def add_products(sums: np.ndarray, x: np.ndarray) -> None:
    """Adds the products of the columns of x, over at most BLOCK rows, to digits (place, column, column)."""
    parts = limbs(x)
    for a, p in enumerate(parts):
        for b, q in enumerate(parts):
            sums[a + b] += (p.T @ q).astype(np.int64)
    for place in range(PLACES - 1):
        carry = sums[place] >> LIMB
        sums[place] -= carry << LIMB
        sums[place + 1] += carry


def valid(column: str) -> Column:
    """Whether a vector and all its entries are there and finite."""
    v = F.col(column)
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def _width(rows: DataFrame, column: str) -> int:
    best = rows.where(valid(column)).groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return best.width if best else 0


def product_sums(rows: DataFrame, column: str, width: int) -> DataFrame:
    """(i, j, s0 to s8) for columns i <= j of the integers with a leading 1: digits of the sums of products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PLACES, width + 1, width + 1), np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(flat), BLOCK):
                x = as_integers(flat[at : at + BLOCK])
                add_products(sums, np.hstack([np.ones((len(x), 1), np.int64), x]))
        i, j = np.triu_indices(width + 1)
        if sums[:, 0, 0].any():
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), **{f"s{p}": sums[p, i, j] for p in range(PLACES)}})

    schema = "i int, j int, " + ", ".join(f"s{p} long" for p in range(PLACES))
    given = rows.where(valid(column) & (F.size(column) == width)).select(F.col(column).cast("array<double>"))
    return given.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(f"s{p}").alias(f"s{p}") for p in range(PLACES)])


@dataclass
class Whitening:
    """What whitens vectors of a width: count, sums of the integers, eigenvalues in falling order, eigenvectors as columns."""

    width: int = 0
    n: int = 0
    sums: list[int] = field(default_factory=list)
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def projection(self) -> np.ndarray:
        """Columns that whiten; NaN where a component has no variance."""
        least = self.width * np.finfo(float).eps * max(self.values, default=0.0)
        scale = np.sqrt(np.where(self.values > least, self.values, np.nan))
        return self.vectors / scale

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they fit, else Python's integers."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 63 else object
        return x.astype(kind) * kind(self.n) - np.array(self.sums, kind) if kind is np.int64 else x.astype(object) * self.n - np.array(self.sums, object)


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """From all valid rows."""
    width = _width(rows, column)
    if not width:
        return Whitening()
    exact = [[0] * (width + 1) for _ in range(width + 1)]
    for r in product_sums(rows, column, width).toLocalIterator():
        exact[r.i][r.j] = exact[r.j][r.i] = sum(r[f"s{p}"] << (LIMB * p) for p in range(PLACES))
    n, s = exact[0][0], exact[0][1:]
    covariance = np.array([[(n * exact[i + 1][j + 1] - s[i] * s[j]) / (n * n) for j in range(width)] for i in range(width)])
    trace = sum(n * exact[i + 1][i + 1] - s[i] * s[i] for i in range(width)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return Whitening(width, n, s, trace, values[order], vectors * np.sign(largest))


def whiten(rows: DataFrame, model: Whitening, column: str = "embedding", into: str = "white") -> DataFrame:
    """The valid rows with a column `into`: struct of deviation and the values of the components."""
    projection = model.projection()

    def run(vectors: pd.Series) -> pd.DataFrame:
        exact = model.deviations(as_integers(np.stack(list(vectors))))
        small = exact.dtype != object and (int(np.abs(exact).max()) ** 2) * model.width < 1 << 63
        squares = (exact * exact).sum(axis=1) if small else (exact.astype(object) ** 2).sum(axis=1)
        values = (exact / model.n).astype(np.float64) @ projection
        return pd.DataFrame({"deviation": pd.array([int(v) if v < 1 << 63 else None for v in squares], dtype="Int64"), "components": [[None if v != v else v for v in z] for z in values.tolist()]})

    run.__annotations__ = {"vectors": pd.Series, "return": pd.DataFrame}
    own = F.pandas_udf(run, "deviation long, components array<double>")
    return rows.where(valid(column) & (F.size(column) == model.width)).withColumn(into, own(F.col(column).cast("array<double>")))


def identity_error(rows: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on all of them. Whitened rows are
    centred as they are made."""
    live = np.flatnonzero(~np.isnan(model.projection()).any(axis=0)) if model.width else []
    if not len(live):
        return None
    k, projection = len(live), model.projection()[:, live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k))
        for batch in batches:
            z = (model.deviations(as_integers(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, model.width))) / model.n).astype(np.float64) @ projection
            sums += z.T @ z
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": sums[i, j]})

    given = rows.where(valid(column) & (F.size(column) == model.width)).select(F.col(column).cast("array<double>"))
    sums = given.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    off = F.abs(F.col("v") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return sums.agg(F.max(off)).first()[0]


def components(rows: DataFrame, key: str, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error) of each valid row and component."""
    model = fit(rows, column, most)
    error = identity_error(rows, model, column)
    share = F.lit([float(v / model.trace) if model.trace else None for v in model.values] or None).cast("array<double>")
    white = whiten(rows, model, column).select(F.col(key), "white.deviation", F.posexplode(F.arrays_zip(F.col("white.components").alias("whitened"), share.alias("explained"))).alias("at", "one"))
    return white.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
