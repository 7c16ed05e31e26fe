"""Pixel kernels in NumPy for whole images, run by Spark over Arrow batches of image rows.

Images are uint8 arrays (h, w, 3) in blue, green, red order; kernels keep shape and type. They follow published definitions;
equality with any imaging library's bits is not claimed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plane
from . import transforms

IMAGE = "height int, width int, nChannels int, mode int, data binary"


def check_image(img: np.ndarray) -> np.ndarray:
    if not isinstance(img, np.ndarray) or img.dtype != np.uint8 or img.ndim != 3 or img.shape[2] != 3 or not img.size:
        raise ValueError("an image is a non-empty uint8 array of three channels")
    return img


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    return _byte(img @ np.array([0.114, 0.587, 0.299]))


def colour(g: np.ndarray) -> np.ndarray:
    return np.repeat(g[..., None], 3, axis=2)


def _each(img: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([f(img[..., c]) for c in range(3)], axis=2)


def convolve(g: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Correlation with reflected borders."""
    ry, rx = taps.shape[0] // 2, taps.shape[1] // 2
    return np.einsum("yxij,ij->yx", sliding_window_view(np.pad(g.astype(np.float64), ((ry, ry), (rx, rx)), "reflect"), taps.shape), taps)


def gaussian(img: np.ndarray, kernel_size: int = 5, sigma: float = 0.0) -> np.ndarray:
    k = np.array(transforms.gaussian_weights(transforms.check_kernel(kernel_size), sigma))
    f = lambda g: _byte(np.round(convolve(convolve(g, k[None, :]), k[:, None]), 6))
    return f(img) if img.ndim == 2 else _each(img, f)


def median(img: np.ndarray, kernel_size: int = 5) -> np.ndarray:
    r = transforms.check_kernel(kernel_size) // 2
    f = lambda g: np.median(sliding_window_view(np.pad(g, r, "edge"), (2 * r + 1,) * 2), axis=(2, 3)).astype(np.uint8)
    return f(img) if img.ndim == 2 else _each(img, f)


def normalize(img: np.ndarray) -> np.ndarray:
    lo, hi = int(img.min()), int(img.max())
    return np.zeros_like(img) if lo == hi else _byte((img.astype(np.float64) - lo) * 255.0 / (hi - lo))


def gamma_table(brightness: float, target_midpoint: float = 0.5) -> np.ndarray:
    """What each level becomes in an image of this mean brightness (0 to 1)."""
    if not 0 < target_midpoint < 1:
        raise ValueError("target_midpoint must lie between 0 and 1")
    if brightness <= 1e-6 or brightness >= 1 - 1e-6:
        return np.arange(256, dtype=np.uint8)
    power = min(2.0, max(0.5, math.log(target_midpoint) / math.log(brightness)))
    return np.floor(np.power(np.arange(256) / 255.0, power) * 255 + 1e-9).astype(np.uint8)


def auto_gamma(img: np.ndarray, target_midpoint: float = 0.5) -> np.ndarray:
    return gamma_table(grey(img).mean() / 255, target_midpoint)[img]


def bilateral(img: np.ndarray, diameter: int = 7, sigma_color: float = 45, sigma_space: float = 45) -> np.ndarray:
    """Weights fall with the distance in place (a disc) and in colour (sum over channels)."""
    if min(diameter, sigma_color, sigma_space) <= 0:
        raise ValueError("diameter and sigmas must be positive")
    r = max(1, diameter // 2)
    h, w = img.shape[:2]
    pad = np.pad(img.astype(np.float64), ((r, r), (r, r), (0, 0)), "reflect")
    num, den = np.zeros((h, w, 3)), np.zeros((h, w, 1))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            near = pad[r + dy : r + dy + h, r + dx : r + dx + w]
            gap = np.abs(near - img).sum(axis=2, keepdims=True)
            weight = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - gap**2 / (2 * sigma_color**2))
            num += weight * near
            den += weight
    return _byte(np.round(num / den, 6))


def unsharp(img: np.ndarray, kernel_size: int = 5, sigma: float = 1.0, amount: float = 1.0, threshold: int = 0) -> np.ndarray:
    if min(sigma, amount, threshold) < 0:
        raise ValueError("sigma, amount and threshold must not be negative")
    smooth = gaussian(img, kernel_size, sigma).astype(np.float64)
    out = _byte(np.round((1 + amount) * img - amount * smooth, 6))
    if threshold > 0:
        low = grey(_byte(np.abs(img - smooth))) < threshold
        out[low] = img[low]
    return out


def _shape(name: str, k: int) -> np.ndarray:
    if name not in plane.SHAPES:
        raise ValueError(f"shape must be one of {sorted(plane.SHAPES)}")
    out = np.zeros((transforms.check_kernel(k),) * 2, bool)
    for dy, dx in plane.SHAPES[name](k):
        out[dy + k // 2, dx + k // 2] = True
    return out


def _extreme(g: np.ndarray, at: np.ndarray, f) -> np.ndarray:
    r = at.shape[0] // 2
    return f(sliding_window_view(np.pad(g, r, "edge"), at.shape)[..., at], axis=-1)


def opening(g: np.ndarray, kernel_size: int = 5, shape: str = "ellipse") -> np.ndarray:
    at = _shape(shape, kernel_size)
    return _extreme(_extreme(g, at, np.min), at, np.max)


def blackhat(img: np.ndarray, kernel_size: int = 9, shape: str = "ellipse") -> np.ndarray:
    g, at = grey(img), _shape(shape, kernel_size)
    return colour(_extreme(_extreme(g, at, np.max), at, np.min) - g)


# Lightness, and contrast-limited equalisation of it

_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(img: np.ndarray) -> np.ndarray:
    c = img[..., ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = (c @ _TO_XYZ.T) / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=2)


def from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(t @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return _byte(c[..., ::-1] * 255)


@dataclass(frozen=True)
class Grid:
    """The cells of contrast-limited equalisation: the image, mirrored up to a multiple of the grid, in size x size cells."""

    height: int
    width: int
    size: int

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("grid_size must be positive")

    @property
    def cell(self) -> tuple[int, int]:
        return -(-self.height // self.size), -(-self.width // self.size)

    def sources(self, axis: int) -> np.ndarray:
        """The row (or column) that each one of the mirrored image comes from."""
        n = (self.height, self.width)
        mirrored = all(c * self.size - m < m for c, m in zip(self.cell, n, strict=True))
        at = np.arange(self.cell[axis] * self.size)
        over = at - n[axis] + 1
        return np.where(over > 0, n[axis] - 1 - over if mirrored else n[axis] - 1, at)

    def counts(self, g: np.ndarray, top: int = 0, left: int = 0) -> np.ndarray:
        """(size * size, 256): how often each cell has a level, of the part of the image that is g and lies at top, left."""
        rows, cols = (np.flatnonzero((s >= o) & (s < o + m)) for s, o, m in ((self.sources(0), top, g.shape[0]), (self.sources(1), left, g.shape[1])))
        level = g[np.ix_(self.sources(0)[rows] - top, self.sources(1)[cols] - left)]
        cell = (rows // self.cell[0])[:, None] * self.size + (cols // self.cell[1])[None, :]
        return np.bincount((cell * 256 + level).ravel(), minlength=self.size**2 * 256).reshape(-1, 256)

    def tables(self, counts: np.ndarray, clip_limit: float) -> np.ndarray:
        """Each cell's counts are clipped, the excess is shared out, their running sum makes a table of levels."""
        if clip_limit <= 0:
            raise ValueError("clip_limit must be positive")
        area = self.cell[0] * self.cell[1]
        limit = max(1, int(clip_limit * area / 256))
        excess = np.maximum(counts - limit, 0).sum(axis=1)
        held = np.minimum(counts, limit) + (excess // 256)[:, None]
        for row, left in zip(held, excess % 256, strict=True):
            if left:
                row[:: max(1, 256 // left)][:left] += 1
        return np.clip(np.rint(np.cumsum(held, axis=1) * 255.0 / area), 0, 255)

    def blend(self, g: np.ndarray, tables: np.ndarray, top: int = 0, left: int = 0) -> np.ndarray:
        """Samples by the tables of the four nearest cells."""
        y, x = (top + np.arange(g.shape[0]) + 0.5) / self.cell[0] - 0.5, (left + np.arange(g.shape[1]) + 0.5) / self.cell[1] - 0.5
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        at = lambda i: np.clip(i, 0, self.size - 1)
        pick = lambda i, j: tables[at(i)[:, None] * self.size + at(j)[None, :], g]
        above = pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx
        below = pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx
        return _byte(np.round(above * (1 - fy) + below * fy, 6))


def clahe(g: np.ndarray, clip_limit: float = 2.0, grid_size: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation."""
    grid = Grid(*g.shape, grid_size)
    return grid.blend(g, grid.tables(grid.counts(g), clip_limit))


def lightness(img: np.ndarray) -> np.ndarray:
    return _byte(to_lab(img)[..., 0] * 2.55)


def with_lightness(img: np.ndarray, light: np.ndarray) -> np.ndarray:
    lab = to_lab(img)
    lab[..., 0] = light / 2.55
    return from_lab(lab)


def lab_clahe(img: np.ndarray, clip_limit: float = 2.0, grid_size: int = 8) -> np.ndarray:
    return with_lightness(img, clahe(lightness(img), clip_limit, grid_size))


# Edges and components


def _sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return convolve(g, k), convolve(g, k.T)


def ridges(g: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ridges above `low`, and those above `high`."""
    dx, dy = _sobel(g)
    mag = np.abs(dx) + np.abs(dy)
    p = np.pad(mag, 1)
    h, w = g.shape
    at = lambda y, x: p[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    angle = np.rad2deg(np.arctan2(dy, dx)) % 180
    ridge = np.zeros((h, w), bool)
    for lo, hi, (y, x) in ((0, 22.5, (0, 1)), (22.5, 67.5, (1, 1)), (67.5, 112.5, (1, 0)), (112.5, 157.5, (1, -1)), (157.5, 180, (0, 1))):
        ridge |= (angle >= lo) & (angle < hi) & (mag > at(-y, -x)) & (mag >= at(y, x))
    return ridge & (mag > low), ridge & (mag > max(low, high))


def canny(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: gradient ridges above `low` that touch one above `high`."""
    weak, strong = ridges(g, low, high)
    labels = components(weak)
    kept = np.unique(labels[strong])
    return np.isin(labels, kept[kept > 0])


def edge_thresholds(median_level: float) -> tuple[int, int]:
    low = int(max(0, 0.66 * median_level))
    return low, int(min(255, max(low + 1, 1.33 * median_level)))


def components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of connected samples in the order of their first sample; the rest is 0. Least labels spread to
    neighbours, by jumps to the label's own label, until none changes."""
    n = mask.size
    ids = np.where(mask, np.arange(n).reshape(mask.shape), n)
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    flat = np.append(ids.ravel(), n)
    h, w = mask.shape
    pairs = []
    for y, x in steps:
        a, b = ids[: h - y, max(0, -x) : w - max(0, x)], ids[y:, max(0, x) : w - max(0, -x)]
        both = (a < n) & (b < n)
        pairs.append((a[both], b[both]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        la, lb = flat[a], flat[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            break
        np.minimum.at(flat, la, low)
        np.minimum.at(flat, lb, low)
        while (flat[flat] != flat).any():
            flat = flat[flat]
    roots = flat[:n]
    _, dense = np.unique(roots[roots < n], return_inverse=True)
    out = np.zeros(n, np.int64)
    out[roots < n] = dense + 1
    return out.reshape(mask.shape)


def edge_metrics(g: np.ndarray) -> tuple[float, float]:
    """Edge density, and the share of edge samples in components of eight or more."""
    edges = canny(g, *edge_thresholds(float(np.median(g))))
    n = int(edges.sum())
    if not n:
        return 0.0, 0.0
    sizes = np.bincount(components(edges).ravel())[1:]
    return n / g.size, float(sizes[sizes >= 8].sum()) / n


def otsu(g: np.ndarray) -> int:
    """The threshold of the largest variance between classes; the lowest of equals."""
    hist = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    w0 = np.cumsum(hist)
    s0 = np.cumsum(hist * np.arange(256))
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - s1 / w1) ** 2, 0)
    return int(np.argmax(np.round(between, 3)))


def contours(img: np.ndarray) -> np.ndarray:
    """The outer outlines of the Otsu mask in green, two samples wide: holes are filled, so their rims are none."""
    g = grey(img)
    mask = g > otsu(g)
    outside = components(np.pad(~mask, 1, constant_values=True), eight=False)
    filled = (outside != outside[0, 0])[1:-1, 1:-1]
    p = np.pad(filled, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    line = filled & ~inner
    line = line | np.pad(line, ((1, 0), (0, 0)))[:-1] & filled
    out = img.copy()
    out[line] = (0, 255, 0)
    return out


#: The polynomials, in falling powers, of the public Turbo colour map (red, green, blue).
TURBO = (
    (59.28637943, -152.94239396, 132.13108234, -42.66032258, 4.61539260, 0.13572138),
    (2.82956604, 4.27729857, -14.18503333, 4.84296658, 2.19418839, 0.09140261),
    (27.34824973, -89.90310912, 110.36276771, -60.58204836, 12.64194608, 0.10667330),
)


def turbo(share: np.ndarray) -> np.ndarray:
    """Colours (blue, green, red) of values from 0 to 1."""
    return _byte(np.stack([np.clip(np.polyval(c, share), 0, 1) * 255 for c in reversed(TURBO)], axis=-1))


def labelled(img: np.ndarray) -> np.ndarray:
    """Components of the Otsu mask, coloured from first to last by the Turbo map; the background is black."""
    g = grey(img)
    labels = components(g > otsu(g))
    out = turbo(labels / max(labels.max(), 1))
    out[labels == 0] = 0
    return out


def derivative(img: np.ndarray, taps) -> np.ndarray:
    r = max(abs(d) for t in taps for d in t[:2])
    k = np.zeros((2 * r + 1,) * 2)
    for dy, dx, c in taps:
        k[dy + r, dx + r] = c
    return colour(_byte(np.abs(convolve(grey(img), k))))


def equalized(img: np.ndarray) -> np.ndarray:
    g = grey(img)
    cdf = np.cumsum(np.bincount(g.ravel(), minlength=256))
    first = cdf[g.min()]
    return img.copy() if first == g.size else colour(_byte((cdf[g] - first) * 255.0 / (g.size - first)))


def saturation(img: np.ndarray) -> np.ndarray:
    top, low = img.max(axis=2).astype(np.float64), img.min(axis=2)
    return _byte(np.where(top > 0, 255.0 * (top - low) / np.maximum(top, 1), 0))


#: Transforms by the names of the catalogue.
REGISTRY: dict[str, Callable[..., np.ndarray]] = {
    "normalize": normalize, "lab_clahe": lab_clahe, "auto_gamma": auto_gamma, "gaussian": gaussian, "median": median, "bilateral": bilateral,
    "unsharp": unsharp, "gray_bgr": lambda img: colour(grey(img)), "blackhat": blackhat,
}


def register(name: str, transform: Callable[..., np.ndarray]) -> None:
    """Makes a transform (image and parameters to image) known to catalogues, advice and benchmark under a new name."""
    if not name.isidentifier() or name in transforms.NAMES:
        raise ValueError(f"a transform needs a name of its own: {name}")
    REGISTRY[name] = transform
    transforms.NAMES.add(name)


#: The explorer's operations: image and kernel size to image.
EXPLORER: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "CLAHE": lambda i, k: lab_clahe(i), "Gaussian Blur": lambda i, k: gaussian(i, k), "Median Blur": lambda i, k: median(i, k), "Bilateral Filter": lambda i, k: bilateral(i),
    "Unsharp Mask": lambda i, k: unsharp(i, k), "HSV Saturation": lambda i, k: colour(saturation(i)), "Histogram Equalization": lambda i, k: equalized(i),
    "Canny": lambda i, k: colour(canny(grey(i), 50, 150).astype(np.uint8) * 255), "Sobel": lambda i, k: derivative(i, transforms.sobel_taps(k)), "Scharr": lambda i, k: derivative(i, transforms.SCHARR),
    "Laplacian": lambda i, k: derivative(i, transforms.laplacian_taps(k)), "Gabor": lambda i, k: derivative(i, transforms.gabor_taps(k)), "Morphological Opening": lambda i, k: colour(opening(grey(i), k)),
    "Blackhat": lambda i, k: blackhat(i, k), "Otsu Threshold": lambda i, k: colour((grey(i) > otsu(grey(i))).astype(np.uint8) * 255), "Contours": lambda i, k: contours(i), "Connected Components": lambda i, k: labelled(i),
}

#: When an operation of the explorer helps, and when it doesn't.
GUIDANCE: dict[str, tuple[str, str]] = {
    "CLAHE": ("low local contrast or uneven light", "fine texture under strong noise"),
    "Gaussian Blur": ("sensor noise of a Gaussian kind", "small edges that matter"),
    "Median Blur": ("salt-and-pepper noise", "thin lines and small dots that matter"),
    "Bilateral Filter": ("smoothing that keeps edges", "little time for each image"),
    "Unsharp Mask": ("soft edges", "strong fine noise"),
    "HSV Saturation": ("classes told apart by colour", "shapes without colour"),
    "Histogram Equalization": ("low contrast of the whole grey image", "colour that must stay"),
    "Canny": ("a clear map of edges", "the strength of texture"),
    "Sobel": ("gradients along one axis", "structure in no direction"),
    "Scharr": ("exact gradients with a small kernel", "noise that was not reduced first"),
    "Laplacian": ("edges in any direction", "noisy originals"),
    "Gabor": ("texture of one direction and period", "data of shapes or colours alone"),
    "Morphological Opening": ("small bright noise", "small bright objects that matter"),
    "Blackhat": ("dark spots on a bright ground", "natural colour in the output"),
    "Otsu Threshold": ("two groups of grey levels", "very uneven light"),
    "Contours": ("outlines of objects in a mask", "texture that doesn't part into objects"),
    "Connected Components": ("number and size of parted objects", "objects that touch"),
}


def explain(spark: SparkSession, rows: DataFrame, technique: str) -> DataFrame:
    """`rows` with helps and hinders of the technique they name, by a join with the table above (one row an operation)."""
    table = spark.createDataFrame([(k, *v) for k, v in GUIDANCE.items()], "technique string, helps string, hinders string")
    return rows.join(F.broadcast(table.withColumnRenamed("technique", technique)), technique, "left")


def diagnose(img: np.ndarray) -> dict[str, float]:
    """The 13 metrics of a whole image."""
    from .diagnostics import illumination_kernel

    g = grey(check_image(img))
    f = g.astype(np.float64)
    h, w = g.shape
    hist = np.bincount(g.ravel(), minlength=256) / g.size
    p = hist[hist > 0]
    smooth = gaussian(g, illumination_kernel(h, w)).astype(np.float64)
    b, gr, r = (img[..., c].astype(np.float64) for c in range(3))
    rg, yb = np.abs(r - gr), np.abs(0.5 * (r + gr) - b)
    density, continuity = edge_metrics(g)
    k = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])
    return {
        "mean_brightness": f.mean(), "dark_clip_ratio": (g <= 5).mean(), "bright_clip_ratio": (g >= 250).mean(), "global_contrast": f.std(),
        "local_contrast": float(np.mean([f[y : y + 16, x : x + 16].std() for y in range(0, h, 16) for x in range(0, w, 16)])),
        "entropy": float(-(p * np.log2(p)).sum()), "sharpness": convolve(g, k).var(), "noise_estimate": float(np.sqrt(((f - median(g, 3)) ** 2).mean())),
        "illumination_nonuniformity": float(smooth.std() / smooth.mean()) if smooth.mean() > 1e-9 else 0.0, "edge_density": density, "edge_continuity": continuity,
        "colorfulness": float(math.sqrt(rg.var() + yb.var()) + 0.3 * math.sqrt(rg.mean() ** 2 + yb.mean() ** 2)), "saturation_spread": saturation(img).astype(np.float64).std(),
    }


# Spark


def to_array(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)


def map_images(images: DataFrame, keys: list[str], f: Callable[..., list[dict]], schema: str, with_row: bool = False) -> DataFrame:
    """Rows (keys, image: struct of the image source) through f, which gives rows for an image; with `with_row`, it gets the
    row of the keys as well. Batches are small: the setting for Arrow is lowered to 32 rows, and stays so for the session, as
    the result is computed later."""
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    fields = "image.height", "image.width", "image.data"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                own = {k: getattr(row, k) for k in keys}
                rows += [own | x for x in (f(to_array(row), row) if with_row else f(to_array(row)))]
            if rows:
                yield pd.DataFrame(rows)

    own = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, *fields).mapInPandas(run, f"{own}, {schema}")
