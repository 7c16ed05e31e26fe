"""Feature vectors of images and of descriptor tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels, scale_space, stacks


def histogram(px: Column, bins: int, top: float) -> Column:
    """Counts of samples from 0 up to `top` in equal bins, inside the row."""
    at = F.transform(px, lambda v: F.floor(v * F.lit(bins / top)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)))


def normalized(counts: Column) -> Column:
    """Shares of the grand total."""
    all_ = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda n: n / F.greatest(all_, F.lit(1e-12)))


def _hue(img: np.ndarray) -> np.ndarray:
    """0 to 179."""
    b, g, r = (img[..., c].astype(np.float64) for c in range(3))
    top, span = img.max(axis=2).astype(np.float64), (img.max(axis=2) - img.min(axis=2)).astype(np.float64)
    d = np.maximum(span, 1)
    h = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 60
    return np.where(span == 0, 0, np.rint((h % 360) / 2) % 180)


def color_histogram(img: np.ndarray, bins: int = 32) -> np.ndarray:
    """Hue, saturation and lightness, as shares of the grand total."""
    light = np.clip(np.rint(kernels.to_lab(img)[..., 0] * 2.55), 0, 255)
    parts = [np.histogram(x, bins, (0, top))[0] for x, top in ((_hue(img), 180), (kernels.saturation(img), 256), (light, 256))]
    out = np.concatenate(parts).astype(np.float32)
    return out / out.sum()


def resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, by centres."""
    y = np.clip((np.arange(h) + 0.5) * g.shape[0] / h - 0.5, 0, g.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * g.shape[1] / w - 0.5, 0, g.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    f = g.astype(np.float64)
    return (f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy


def hog(img: np.ndarray, size: int = 128, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Gradient histograms of cells, in blocks of 2 x 2 cells, each normalised, cut at 0.2 and normalised again."""
    return hog_values(img, size, cell, bins).astype(np.float32)


def hog_values(img: np.ndarray, size: int = 128, cell: int = 8, bins: int = 9) -> np.ndarray:
    if size % 16:
        raise ValueError("size must be a multiple of 16")
    g = resize(kernels.grey(img), size, size)
    p = np.pad(g, 1, "reflect")
    dx, dy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    mag, at = np.hypot(dx, dy), (np.rad2deg(np.arctan2(dy, dx)) % 180) / (180 / bins) - 0.5
    lo = np.floor(at).astype(int)
    share, n = at - lo, size // cell
    where = (np.arange(size) // cell)[:, None] * n + (np.arange(size) // cell)[None, :]
    cells = sum(np.bincount((where * bins + b % bins).ravel(), (mag * s).ravel(), n * n * bins) for b, s in ((lo, 1 - share), (lo + 1, share))).reshape(n, n, bins)
    blocks = np.concatenate([cells[:-1, :-1], cells[1:, :-1], cells[:-1, 1:], cells[1:, 1:]], axis=2)
    unit = lambda b: b / np.sqrt((b * b).sum(axis=2, keepdims=True) + 1e-6)
    return unit(np.minimum(unit(blocks), 0.2)).ravel()


def texture_stats(img: np.ndarray, size: int = 128) -> np.ndarray:
    """Mean, deviation and the 75th and 95th percentile of six absolute filter responses."""
    g = resize(kernels.grey(img), size, size) / 255.0
    dx, dy = kernels._sobel(g)
    responses = [np.hypot(dx, dy), kernels.convolve(g, np.array([[2.0, 0, 2], [0, -8, 0], [2, 0, 2]]))]
    y, x = np.mgrid[-7:8, -7:8]
    for theta in (0, math.pi / 4, math.pi / 2, 3 * math.pi / 4):
        a, b = x * math.cos(theta) + y * math.sin(theta), -x * math.sin(theta) + y * math.cos(theta)
        responses.append(kernels.convolve(g, np.exp(-(a * a + 0.25 * b * b) / 18) * np.cos(2 * math.pi * a / 8)))
    out = [f for r in map(np.abs, responses) for f in (r.mean(), r.std(), *np.percentile(r, (75, 95)))]
    return np.array(out, np.float32)


def combined(img: np.ndarray) -> np.ndarray:
    return np.concatenate([color_histogram(img), hog(img), texture_stats(img)])


EXTRACTORS = {"color": color_histogram, "shape": hog, "texture": texture_stats, "combined": combined}


def register(name: str, extractor: Callable[[np.ndarray], np.ndarray]) -> None:
    """Makes a feature profile (image to vector, of one length for all images) known to the benchmark under a new name."""
    if not name.isidentifier() or name in EXTRACTORS:
        raise ValueError(f"a feature profile needs a name of its own: {name}")
    EXTRACTORS[name] = extractor


def extract(images: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """(keys, features array<float>) of whole images."""
    if profile not in EXTRACTORS:
        raise ValueError(f"unknown feature profile: {profile}")
    f = EXTRACTORS[profile]
    return kernels.map_images(images, keys, lambda img: [{"features": f(img).tolist()}], "features array<float>")


def top_descriptors(descriptors: DataFrame, image: str, response: str, tie: str, n: int = 250) -> DataFrame:
    """The n strongest rows of each image."""
    return descriptors.withColumn("place", F.row_number().over(W.partitionBy(image).orderBy(F.desc(response), tie))).where(F.col("place") <= n)


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def nearest_words(descriptors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`descriptors` with the nearest word; the lowest wins ties. The vocabulary (a few dozen rows by its parameter k) is one
    broadcast array, so descriptors stay where they are."""
    words = vocabulary.agg(F.array_sort(F.collect_list(F.struct("word_id", F.col("centre")))).alias("words"))
    best = F.array_min(F.transform("words", lambda w: F.struct(F.round(_squared(F.col("features"), w.centre), 9).alias("d"), w.word_id.alias("word_id"))))
    return descriptors.crossJoin(F.broadcast(words)).withColumn("word_id", best.word_id).drop("words")


def word_histograms(assigned: DataFrame, image: str, k: int, images: DataFrame | None = None) -> DataFrame:
    """(image, histogram): shares of the words, zeros included. Of `images`, those without descriptors get zeros alone."""
    counts = assigned.groupBy(image, "word_id").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct("word_id", "n"))).alias("m"), F.sum("n").alias("all"))
    if images is not None:
        held = images.select(image).distinct().join(held, image, "left")
    share = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("all"), F.lit(0.0)))
    return held.select(image, share.alias("histogram"))


def gradient_descriptors(images: DataFrame, keys: list[str], most: int = 250, patch: int = 16, cells: int = 4, bins: int = 8) -> DataFrame:
    """(keys, y, x, response, features) of an image's strongest corners, by the determinant of smoothed gradient products (less a
    share of their trace). A descriptor is the gradient histograms of cells x cells parts of the patch around it, of length 1,
    clipped at 0.2 and normalised again. An image too small or too flat has none."""

    def one(img) -> list[dict]:
        g = kernels.grey(img).astype(np.float64)
        h, w = g.shape
        if min(h, w) < patch:
            return []
        dy, dx = np.gradient(g)
        smooth = lambda a: kernels.convolve(kernels.convolve(a, _BLUR[None, :]), _BLUR[:, None])
        yy, xx, xy = smooth(dy * dy), smooth(dx * dx), smooth(dx * dy)
        corner = np.round(yy * xx - xy * xy - 0.04 * (yy + xx) ** 2, 6)
        r = patch // 2
        inner = corner[r : h - r + 1, r : w - r + 1]
        p = np.pad(inner, 1, constant_values=-np.inf)
        peak = inner > 0
        for y, x in [(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if (a, b) != (1, 1)]:
            peak &= inner >= p[y : y + inner.shape[0], x : x + inner.shape[1]]
        at = np.argwhere(peak)
        at = at[np.lexsort((at[:, 1], at[:, 0], -inner[peak]))][:most]
        size, turn, out = np.hypot(dy, dx), np.floor((np.arctan2(dy, dx) / (2 * np.pi) % 1) * bins).astype(int) % bins, []
        cell = np.repeat(np.repeat(np.arange(cells * cells).reshape(cells, cells), patch // cells, axis=0), patch // cells, axis=1)
        for y, x in at:
            part = (slice(y, y + patch), slice(x, x + patch))
            v = np.bincount((cell * bins + turn[part]).ravel(), size[part].ravel(), cells * cells * bins)
            v = np.minimum(v / max(np.linalg.norm(v), 1e-9), 0.2)
            out.append({"y": int(y + r), "x": int(x + r), "response": float(inner[y, x]), "features": (v / max(np.linalg.norm(v), 1e-9)).tolist()})
        return out

    return kernels.map_images(images, keys, one, "y int, x int, response double, features array<double>")


def scale_descriptors(images: DataFrame, keys: list[str], most: int = 250) -> DataFrame:
    """(keys, y, x, scale, angle, response, features array<double> of 128) of the `most` strongest keypoints of each image, which
    keep their descriptors when it is turned or resized. An image too small or too flat has none."""
    return stacks.map_stacks(images, keys, lambda x: scale_space.describe_stack(kernels.grey(x), most), "y double, x double, scale double, angle double, response double, features array<double>")


def fold_words(descriptors: DataFrame, image: str, images: DataFrame, k: int = 32, fold: str = "fold", seed: int = 42) -> DataFrame:
    """(test_fold, image, histogram): for each fold of `images` (image, fold) a vocabulary of the other folds' descriptors alone,
    and the shares of its words in every image. Descriptors may carry their image's fold, else they are joined with it. Both tables
    are read once for each vocabulary: write them first. The words of all folds are counted in one pass over the descriptors."""
    folds = sorted(r[0] for r in images.select(fold).distinct().collect())
    owned = descriptors if fold in descriptors.columns else descriptors.join(images.select(image, fold), image)
    words = [np.array([r.centre for r in fit_vocabulary(owned.where(F.col(fold) != f), k, seed).orderBy("word_id").collect()]) for f in folds]
    kind = descriptors.schema[image].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each image in a batch: how often each word of each fold is the nearest, the lowest of equals."""
        for b in batches:
            if not b.num_rows:
                continue
            x, own = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float), b.column(0).dictionary_encode()
            at, n = own.indices.to_numpy(), len(own.dictionary)
            square = (x * x).sum(1)[:, None]
            near = [np.round(np.maximum(square + (w * w).sum(1) - 2 * x @ w.T, 0), 9).argmin(1) for w in words]
            counts = np.hstack([np.bincount(at * k + word, minlength=n * k).reshape(n, k) for word in near])
            yield pa.RecordBatch.from_arrays([own.dictionary, pa.array(list(counts), pa.list_(pa.int64()))], names=["image", "counts"])

    found = descriptors.select(image, "features").mapInArrow(counted, f"image {kind}, counts array<bigint>")
    sums = found.groupBy("image").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(len(folds) * k)])
    share = lambda n: F.transform(F.array(*n), lambda x: F.coalesce(x / F.greatest(F.aggregate(F.array(*n), F.lit(0).cast("long"), lambda a, v: a + v), F.lit(1)), F.lit(0.0)))
    of_folds = F.array(*[F.struct(F.lit(f).alias("test_fold"), share([F.coalesce(F.col(f"n{j}"), F.lit(0).cast("long")) for j in range(i * k, i * k + k)]).alias("histogram")) for i, f in enumerate(folds)])
    every = images.select(image).distinct().join(sums.withColumnRenamed("image", image), image, "left")
    return every.select(image, F.inline(of_folds)).select("test_fold", image, "histogram")


_BLUR = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16


def fit_vocabulary(descriptors: DataFrame, k: int = 32, seed: int = 42) -> DataFrame:
    """(word_id, centre) by k-means on the cluster; at least k descriptors are needed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = descriptors.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    if len(rows.take(k)) < k:
        raise ValueError("fewer descriptors than words")
    model = KMeans(k=k, seed=seed).fit(rows)
    data = [(i, [float(x) for x in c]) for i, c in enumerate(sorted(map(list, model.clusterCenters())))]
    return descriptors.sparkSession.createDataFrame(data, "word_id int, centre array<double>")


