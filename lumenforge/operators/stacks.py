"""The kernels on stacks of images of one size, (n, height, width, 3): the same values as image by image, by few calls of NumPy.

On small images those calls, not the samples, take the time of `kernels`. Tests hold each function here against its kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kernels, transforms
from .diagnostics import illumination_kernel
from .kernels import _byte, grey

#: Samples of a stack, so that a task's arrays stay small; a larger image is a stack of its own.
SAMPLES = 1 << 19


def _padded(x: np.ndarray, ry: int, rx: int, mode: str) -> np.ndarray:
    """With borders on the two axes after the first."""
    return np.pad(x, [(0, 0), (ry, ry), (rx, rx)] + [(0, 0)] * (x.ndim - 3), mode)


def convolve(g: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Correlation of planes (n, h, w, ...) with reflected borders."""
    ry, rx = taps.shape[0] // 2, taps.shape[1] // 2
    p, (h, w) = _padded(g.astype(np.float64), ry, rx, "reflect"), g.shape[1:3]
    out = np.zeros(g.shape)
    for (y, x), c in np.ndenumerate(taps):
        if c:
            out += c * p[:, y : y + h, x : x + w]
    return out


def gaussian(x: np.ndarray, kernel_size: int = 5, sigma: float = 0.0) -> np.ndarray:
    k = np.array(transforms.gaussian_weights(transforms.check_kernel(kernel_size), sigma))
    return _byte(np.round(convolve(convolve(x, k[None, :]), k[:, None]), 6))


def median(x: np.ndarray, kernel_size: int = 5) -> np.ndarray:
    """The middle level of each window, bit by bit from the highest: the largest that most of the window reaches."""
    r = transforms.check_kernel(kernel_size) // 2
    n, p, (h, w) = 2 * r + 1, _padded(x, r, r, "edge"), x.shape[1:3]
    out, least = np.zeros_like(x), n * n // 2 + 1
    for bit in (128, 64, 32, 16, 8, 4, 2, 1):
        level, count = out | np.uint8(bit), np.zeros(x.shape, np.uint8 if n * n < 256 else np.uint16)
        for dy in range(n):
            for dx in range(n):
                count += p[:, dy : dy + h, dx : dx + w] >= level
        out = np.where(count >= least, level, out)
    return out


def normalize(x: np.ndarray) -> np.ndarray:
    lo, hi = (f(x, axis=(1, 2, 3), keepdims=True).astype(np.float64) for f in (np.min, np.max))
    return np.where(lo == hi, np.uint8(0), _byte((x.astype(np.float64) - lo) * 255.0 / np.where(lo == hi, 1, hi - lo)))


def auto_gamma(x: np.ndarray, target_midpoint: float = 0.5) -> np.ndarray:
    return np.stack([kernels.gamma_table(g.mean() / 255, target_midpoint)[img] for img, g in zip(x, grey(x), strict=True)])


def bilateral(x: np.ndarray, diameter: int = 7, sigma_color: float = 45, sigma_space: float = 45) -> np.ndarray:
    """Gaps of colour are whole numbers up to 765, so the weights of each distance come from a table."""
    if min(diameter, sigma_color, sigma_space) <= 0:
        raise ValueError("diameter and sigmas must be positive")
    r = max(1, diameter // 2)
    h, w = x.shape[1:3]
    own, gaps = x.astype(np.int16), np.arange(766.0)
    pad = _padded(own, r, r, "reflect")
    num, den = np.zeros(x.shape), np.zeros((*x.shape[:3], 1))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            near = pad[:, r + dy : r + dy + h, r + dx : r + dx + w]
            apart = np.abs(near - own)
            table = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - gaps**2 / (2 * sigma_color**2))
            weight = table[apart[..., 0] + apart[..., 1] + apart[..., 2]][..., None]
            num += weight * near
            den += weight
    return _byte(np.round(num / den, 6))


def unsharp(x: np.ndarray, kernel_size: int = 5, sigma: float = 1.0, amount: float = 1.0, threshold: int = 0) -> np.ndarray:
    if min(sigma, amount, threshold) < 0:
        raise ValueError("sigma, amount and threshold must not be negative")
    smooth = gaussian(x, kernel_size, sigma).astype(np.float64)
    out = _byte(np.round((1 + amount) * x - amount * smooth, 6))
    if threshold > 0:
        low = grey(_byte(np.abs(x - smooth))) < threshold
        out[low] = x[low]
    return out


_LEVEL = np.arange(256) / 255.0
_LINEAR = np.where(_LEVEL > 0.04045, ((_LEVEL + 0.055) / 1.055) ** 2.4, _LEVEL / 12.92)


def to_lab(x: np.ndarray) -> np.ndarray:
    t = (_LINEAR[x[..., ::-1]] @ kernels._TO_XYZ.T) / kernels._WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def lab_clahe(x: np.ndarray, clip_limit: float = 2.0, grid_size: int = 8) -> np.ndarray:
    lab = to_lab(x)
    lab[..., 0] = clahe(_byte(lab[..., 0] * 2.55), clip_limit, grid_size) / 2.55
    return kernels.from_lab(lab)


#: Which levels get one more of what is left over of an excess, by how much that is.
_SPREAD = np.array([(np.arange(256) % max(1, 256 // max(n, 1)) == 0) & (np.arange(256) // max(1, 256 // max(n, 1)) < n) for n in range(256)])


def clahe(g: np.ndarray, clip_limit: float = 2.0, grid_size: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of planes (n, h, w)."""
    if clip_limit <= 0:
        raise ValueError("clip_limit must be positive")
    grid = kernels.Grid(*g.shape[1:], grid_size)
    rows, cols = grid.sources(0), grid.sources(1)
    cell = (np.arange(len(rows)) // grid.cell[0])[:, None] * grid_size + (np.arange(len(cols)) // grid.cell[1])[None, :]
    of_image = np.arange(len(g))[:, None, None] * grid_size**2
    counts = np.bincount((((of_image + cell) * 256) + g[:, rows[:, None], cols[None, :]]).ravel(), minlength=len(g) * grid_size**2 * 256).reshape(-1, 256)
    area = grid.cell[0] * grid.cell[1]
    limit = max(1, int(clip_limit * area / 256))
    held = np.minimum(counts, limit)
    excess = (counts - held).sum(axis=1)
    held += (excess // 256)[:, None] + _SPREAD[excess % 256]
    tables = np.clip(np.rint(np.cumsum(held, axis=1) * 255.0 / area), 0, 255)
    y, x = (np.arange(n) + 0.5 for n in g.shape[1:])
    y, x = y / grid.cell[0] - 0.5, x / grid.cell[1] - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i: np.clip(i, 0, grid_size - 1)
    pick = lambda i, j: tables[of_image + at(i)[:, None] * grid_size + at(j)[None, :], g]
    above = pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx
    below = pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx
    return _byte(np.round(above * (1 - fy) + below * fy, 6))


# Edges and components


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of the eight-connected samples of planes (n, h, w): `kernels.components` of the planes one below the other, with
    an empty row between them. Labels run on from plane to plane; the rest is 0."""
    n, h, w = mask.shape
    return kernels.components(np.pad(mask, [(0, 0), (0, 1), (0, 0)]).reshape(n * (h + 1), w)).reshape(n, h + 1, w)[:, :h]


def canny(g: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Edges of planes, each with its own thresholds."""
    k = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    dx, dy = convolve(g, k), convolve(g, k.T)
    mag = np.abs(dx) + np.abs(dy)
    p, (h, w) = np.pad(mag, [(0, 0), (1, 1), (1, 1)]), g.shape[1:]
    at = lambda y, x: p[:, 1 + y : 1 + y + h, 1 + x : 1 + x + w]
    angle = np.rad2deg(np.arctan2(dy, dx)) % 180
    ridge = np.zeros(g.shape, bool)
    for lo, hi, (y, x) in ((0, 22.5, (0, 1)), (22.5, 67.5, (1, 1)), (67.5, 112.5, (1, 0)), (112.5, 157.5, (1, -1)), (157.5, 180, (0, 1))):
        ridge |= (angle >= lo) & (angle < hi) & (mag > at(-y, -x)) & (mag >= at(y, x))
    low, high = low[:, None, None], np.maximum(low, high)[:, None, None]
    labels = components(ridge & (mag > low))
    kept = np.zeros(labels.max(initial=0) + 1, bool)
    kept[labels[ridge & (mag > high)]] = True
    kept[0] = False
    return kept[labels]


def edge_metrics(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.array([kernels.edge_thresholds(float(m)) for m in np.median(g.reshape(len(g), -1), axis=1)]).T
    edges = canny(g, low, high)
    labels = components(edges)
    large = np.bincount(labels.ravel()) >= 8
    large[0] = False
    n, far = edges.reshape(len(g), -1).sum(1), large[labels].reshape(len(g), -1).sum(1)
    return n / g[0].size, far / np.maximum(n, 1)


def diagnose(x: np.ndarray) -> dict[str, np.ndarray]:
    """The 13 metrics of each image."""
    if x.dtype != np.uint8 or x.ndim != 4 or x.shape[3] != 3 or not x.size:
        raise ValueError("a stack holds non-empty uint8 images of three channels")
    g = grey(x)
    n, h, w = g.shape
    f = g.astype(np.float64)
    flat = lambda a: np.ascontiguousarray(a).reshape(n, -1)
    p = np.bincount((np.arange(n)[:, None] * 256 + flat(g)).ravel(), minlength=n * 256).reshape(n, 256) / (h * w)
    smooth = flat(gaussian(g, illumination_kernel(h, w)).astype(np.float64))
    b, gr, r = (x[..., c].astype(np.float64) for c in range(3))
    rg, yb = flat(np.abs(r - gr)), flat(np.abs(0.5 * (r + gr) - b))
    top = x.max(axis=3).astype(np.float64)
    saturation = _byte(np.where(top > 0, 255.0 * (top - x.min(axis=3)) / np.maximum(top, 1), 0)).astype(np.float64)
    density, continuity = edge_metrics(g)
    mean = smooth.mean(1)
    return {
        "mean_brightness": flat(f).mean(1), "dark_clip_ratio": flat(g <= 5).mean(1), "bright_clip_ratio": flat(g >= 250).mean(1), "global_contrast": flat(f).std(1),
        "local_contrast": np.mean([flat(f[:, y : y + 16, x : x + 16]).std(1) for y in range(0, h, 16) for x in range(0, w, 16)], axis=0),
        "entropy": -(p * np.log2(np.where(p > 0, p, 1))).sum(1), "sharpness": flat(convolve(g, np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]]))).var(1), "noise_estimate": np.sqrt(flat((f - median(g, 3)) ** 2).mean(1)),
        "illumination_nonuniformity": np.where(mean > 1e-9, smooth.std(1) / np.maximum(mean, 1e-9), 0.0), "edge_density": density, "edge_continuity": continuity,
        "colorfulness": np.sqrt(rg.var(1) + yb.var(1)) + 0.3 * np.sqrt(rg.mean(1) ** 2 + yb.mean(1) ** 2), "saturation_spread": flat(saturation).std(1),
    }


#: Transforms of stacks by the kernel that each one stands for.
STACKED: dict[Callable, Callable[..., np.ndarray]] = {
    kernels.normalize: normalize, kernels.lab_clahe: lab_clahe, kernels.auto_gamma: auto_gamma, kernels.gaussian: gaussian, kernels.median: median, kernels.bilateral: bilateral,
    kernels.unsharp: unsharp, kernels.REGISTRY["gray_bgr"]: lambda x: np.repeat(grey(x)[..., None], 3, axis=3),
}


def stacked(transform: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    """A transform for stacks; one without a form of its own is applied image by image."""
    return STACKED.get(transform) or (lambda x, **params: np.stack([kernels.check_image(transform(img, **params)) for img in x]))


def map_stacks(images: DataFrame, keys: list[str], f: Callable[[np.ndarray], list[list[dict]]], schema: str) -> DataFrame:
    """As `kernels.map_images`, with f for a stack: it gives rows for each of its images. The images of a batch that have one size
    are stacked."""
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, sizes = [], {}
            for i, size in enumerate(zip(b["height"], b["width"], strict=True)):
                sizes.setdefault(size, []).append(i)
            for (h, w), own in sizes.items():
                step = max(1, SAMPLES // max(1, h * w * 3))
                for part in (own[i : i + step] for i in range(0, len(own), step)):
                    x = np.stack([np.frombuffer(b["data"].iat[i], np.uint8).reshape(h, w, 3) for i in part])
                    for i, found in zip(part, f(x), strict=True):
                        rows += [{k: b[k].iat[i] for k in keys} | r for r in found]
            if rows:
                yield pd.DataFrame(rows)

    own = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "image.height", "image.width", "image.data").mapInPandas(run, f"{own}, {schema}")
