"""Preprocessing transforms on grey planes as expressions: shape and range are kept, nothing is shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import plane


def check_kernel(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1 or k % 2 == 0:
        raise ValueError("kernel_size must be a positive odd number")
    return k


def gaussian_weights(k: int, sigma: float = 0.0) -> list[float]:
    """Normalised weights; a sigma of 0 is derived from the size."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    s = sigma or 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - k // 2) ** 2) / (2 * s * s)) for i in range(k)]
    return [x / sum(raw) for x in raw]


def normalize(px: Column, h: Column, w: Column) -> Column:
    """The range of the samples stretched to 0 to 255; a constant image gives 0."""
    ends = F.struct(F.array_min(px).alias("low"), F.array_max(px).alias("high"))
    scale = lambda e: F.transform(px, lambda v: F.when(e.high == e.low, 0).otherwise(plane.byte((v - e.low) * 255.0 / F.greatest(e.high - e.low, F.lit(1)))))
    return plane.once(ends, scale)


def auto_gamma(px: Column, h: Column, w: Column, target: float = 0.5) -> Column:
    """Brightness moved towards `target` by a power of 0.5 to 2; results are cut, not rounded."""
    if not 0 < target < 1:
        raise ValueError("target_midpoint must lie between 0 and 1")

    def moved(m: Column) -> Column:
        safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), m))
        power = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(math.log(target)) / F.log(safe)))
        flat = (m <= 1e-6) | (m >= 1 - 1e-6)
        return plane.once(power, lambda e: F.transform(px, lambda v: F.when(flat, v).otherwise(F.floor(F.pow(v / 255.0, e) * 255 + 1e-9).cast("int"))))

    return plane.once(plane.mean(px) / 255, moved)


def gaussian_plane(px: Column, h: Column, w: Column, k: int, sigma: float = 0.0) -> Column:
    weights = gaussian_weights(check_kernel(k), sigma)
    across = plane.weighted(px, h, w, [(0, i - k // 2, c) for i, c in enumerate(weights)])
    return plane.once(across, lambda p: plane.weighted(p, h, w, [(i - k // 2, 0, c) for i, c in enumerate(weights)]))


def gaussian(px: Column, h: Column, w: Column, k: int = 5, sigma: float = 0.0) -> Column:
    """Two passes, along rows and then along columns."""
    return F.transform(gaussian_plane(px, h, w, k, sigma), lambda v: plane.byte(F.round(v, 6)))


def median(px: Column, h: Column, w: Column, k: int = 5) -> Column:
    offsets = plane.square(check_kernel(k))
    return plane.neighbours(px, h, w, "replicate", lambda at: F.get(F.sort_array(F.array(*[at(dy, dx) for dy, dx in offsets])), F.lit(k * k // 2)))


def unsharp(px: Column, h: Column, w: Column, k: int = 5, sigma: float = 1.0, amount: float = 1.0, threshold: int = 0) -> Column:
    """Differences from the smoothed image are enlarged; where they lie below the threshold the sample stays."""
    if min(sigma, amount, threshold) < 0:
        raise ValueError("sigma, amount and threshold must not be negative")
    smooth = gaussian(px, h, w, k, sigma)
    return F.zip_with(px, smooth, lambda v, s: F.when(F.abs(v - s) < threshold, v).otherwise(plane.byte(F.round(v * F.lit(1.0 + amount) - s * F.lit(float(amount)), 6))))


def opening(px: Column, h: Column, w: Column, k: int = 5, shape: str = "ellipse") -> Column:
    offsets = plane.SHAPES[shape](check_kernel(k))
    return plane.once(plane.extreme(px, h, w, offsets, False), lambda p: plane.extreme(p, h, w, offsets, True))


def closing(px: Column, h: Column, w: Column, k: int = 5, shape: str = "ellipse") -> Column:
    offsets = plane.SHAPES[shape](check_kernel(k))
    return plane.once(plane.extreme(px, h, w, offsets, True), lambda p: plane.extreme(p, h, w, offsets, False))


def blackhat(px: Column, h: Column, w: Column, k: int = 9, shape: str = "ellipse") -> Column:
    """What closing fills in."""
    if shape not in plane.SHAPES:
        raise ValueError(f"shape must be one of {sorted(plane.SHAPES)}")
    return F.zip_with(closing(px, h, w, k, shape), px, lambda a, b: a - b)


def bilateral(px: Column, h: Column, w: Column, diameter: int = 7, sigma_color: float = 45.0, sigma_space: float = 45.0, channels: int = 3) -> Column:
    """Means of a disc, weighted by nearness in place and in level. A level counts `channels` times in a distance, as a grey image of
    so many equal channels has it."""
    if min(diameter, sigma_color, sigma_space) <= 0:
        raise ValueError("diameter and sigmas must be positive")
    r = max(1, diameter // 2)
    disc = [(dy, dx) for dy, dx in plane.square(2 * r + 1) if dy * dy + dx * dx <= r * r]

    def fold(at):
        def add(acc: Column, near: Column) -> Column:
            gap = (near.v - at(0, 0)) * channels
            weight = F.exp(near.far - gap * gap / F.lit(2.0 * sigma_color**2))
            return F.struct((acc.total + weight * near.v).alias("total"), (acc.weight + weight).alias("weight"))

        near = F.array(*[F.struct(at(dy, dx).cast("double").alias("v"), F.lit(-(dy * dy + dx * dx) / (2.0 * sigma_space**2)).alias("far")) for dy, dx in disc])
        zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"))
        return F.aggregate(near, zero, add, lambda acc: plane.byte(F.round(acc.total / acc.weight, 6)))

    return plane.neighbours(px, h, w, "reflect", fold)


def clahe(px: Column, h: Column, w: Column, clip_limit: float = 2.0, grid_size: int = 8) -> Column:
    """Contrast-limited adaptive equalisation: a table of 256 levels for each cell of the grid, as an array in the row; samples
    blend those of the four nearest cells. The image is mirrored up to a multiple of the grid."""
    if clip_limit <= 0 or grid_size <= 0:
        raise ValueError("clip_limit and grid_size must be positive")
    up, k = (lambda n: F.ceil(n / grid_size).cast("int")), grid_size
    levels = F.sequence(F.lit(0), F.lit(255))
    mirrored = (up(h) * k - h < h) & (up(w) * k - w < w)
    source = lambda i, n: F.when(i < n, i).when(mirrored, 2 * (n - 1) - i).otherwise(n - 1)
    area = up(h) * up(w)
    limit = F.greatest(F.lit(1), F.floor(F.lit(float(clip_limit)) * area / 256).cast("int"))

    def table(cell: Column) -> Column:
        top, left = F.floor(cell / k).cast("int") * up(h), (cell % k) * up(w)
        held = F.transform(F.sequence(F.lit(0), area - 1), lambda i: F.get(px, source(top + F.floor(i / up(w)).cast("int"), h) * w + source(left + i % up(w), w)))
        counts = plane.once(held, lambda own: F.transform(levels, lambda v: F.size(F.filter(own, lambda x: x == v))))

        def clipped(c: Column) -> Column:
            excess = F.aggregate(c, F.lit(0), lambda a, n: a + F.greatest(n - limit, F.lit(0)))
            return plane.once(excess, lambda e: F.transform(c, lambda n, i: F.least(n, limit) + F.floor(e / 256).cast("int") + extra(e % 256, i)))

        def extra(left_over: Column, i: Column) -> Column:
            step = F.greatest(F.lit(1), F.floor(F.lit(256) / F.greatest(left_over, F.lit(1))).cast("int"))
            return F.when((i % step == 0) & (i / step < left_over), 1).otherwise(0)

        upto = lambda c: F.transform(levels, lambda v: F.aggregate(F.slice(c, F.lit(1), v + 1), F.lit(0), lambda a, n: a + n))
        level = lambda n: plane.byte(n * F.lit(255.0) / area)
        return plane.once(counts, lambda c: plane.once(clipped(c), lambda own: F.transform(plane.once(own, upto), level)))

    def blended(tables: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            y, x = (F.floor(i / w) + 0.5) / up(h) - 0.5, (i % w + 0.5) / up(w) - 0.5
            y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
            fy, fx = y - y0, x - x0
            inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(k - 1), c))
            at = lambda r, c: F.get(F.get(tables, inside(r) * k + inside(c)), v)
            above, below = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
            return plane.byte(F.round(above * (1 - fy) + below * fy, 6))

        return F.transform(px, one)

    return plane.once(F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), table), blended)


def grey_to_colour(px: Column, h: Column, w: Column) -> Column:
    """Grey replicated to three planes; on a grey plane the same values."""
    return px


SOBEL = tuple((dy, dx, s * c) for dy, c in ((-1, 1), (0, 2), (1, 1)) for dx, s in ((-1, -1), (1, 1)))
SCHARR = tuple((dy, dx, s * c) for dy, c in ((-1, 3), (0, 10), (1, 3)) for dx, s in ((-1, -1), (1, 1)))
LAPLACIAN = ((-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4))


def _spread(times: int, start: tuple[int, ...]) -> list[int]:
    """Coefficients smoothed so many times with (1, 1)."""
    out = list(start)
    for _ in range(times):
        out = [a + b for a, b in zip([*out, 0], [0, *out], strict=True)]
    return out


def _outer(down: list[int], across: list[int]) -> list[list[int]]:
    return [[y * x for x in across] for y in down]


def _taps(grid: list[list[int]]) -> tuple[tuple[int, int, int], ...]:
    r = len(grid) // 2
    return tuple((y - r, x - r, c) for y, row in enumerate(grid) for x, c in enumerate(row) if c)


def sobel_taps(k: int) -> tuple[tuple[int, int, int], ...]:
    """First derivative across, smoothed down; of size 1, the bare difference."""
    k = check_kernel(k)
    return ((0, -1, -1), (0, 1, 1)) if k == 1 else _taps(_outer(_spread(k - 1, (1,)), _spread(k - 3, (-1, 0, 1))))


def laplacian_taps(k: int) -> tuple[tuple[int, int, int], ...]:
    """Second derivatives both ways, each smoothed the other way; of size 1, the four neighbours."""
    k = check_kernel(k)
    if k == 1:
        return LAPLACIAN
    across = _outer(_spread(k - 1, (1,)), _spread(k - 3, (1, -2, 1)))
    return _taps([[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(across, zip(*across, strict=True), strict=True)])



def derivative(px: Column, h: Column, w: Column, taps) -> Column:
    """Absolute response, saturated."""
    return F.transform(plane.weighted(px, h, w, taps), lambda v: plane.byte(F.abs(v)))


def gabor_taps(k: int) -> list[plane.Tap]:
    """Angle 45 degrees, aspect 0.5, phase 0; width and wave length follow the size."""
    s, wave, theta, r = max(1.0, k / 5), max(2.0, k / 2), math.pi / 4, check_kernel(k) // 2
    taps = []
    for dy, dx in plane.square(k):
        a, b = dx * math.cos(theta) + dy * math.sin(theta), -dx * math.sin(theta) + dy * math.cos(theta)
        taps.append((dy, dx, math.exp(-(a * a + 0.25 * b * b) / (2 * s * s)) * math.cos(2 * math.pi * a / wave)))
    assert r >= 0
    return taps


#: The transforms a catalogue may name.
REGISTRY: dict[str, Callable[..., Column]] = {
    "normalize": normalize, "auto_gamma": auto_gamma, "gaussian": gaussian, "median": median, "unsharp": unsharp, "bilateral": bilateral, "gray_bgr": grey_to_colour, "blackhat": blackhat,
}


#: All transforms by name: those above, those that are kernels alone, and what is registered beside them.
NAMES = {*REGISTRY, "lab_clahe"}


def check_config(name: str, params: dict) -> None:
    if name not in NAMES:
        raise ValueError(f"unknown transform: {name}")
    if "kernel_size" in params:
        check_kernel(params["kernel_size"])
