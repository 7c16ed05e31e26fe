"""Per-image quality metrics, computed inside the image's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour, plane
from . import transforms

#: The metrics of an image, in order.
METRICS = (
    "mean_brightness", "dark_clip_ratio", "bright_clip_ratio", "global_contrast", "local_contrast", "entropy", "sharpness",
    "noise_estimate", "illumination_nonuniformity", "edge_density", "edge_continuity", "colorfulness", "saturation_spread",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_brightness(px: Column | str = "px") -> Column:
    px = _c(px)
    return plane.mean(px)


def dark_clip_ratio(px: Column | str = "px") -> Column:
    px = _c(px)
    return plane.mean(px, lambda x: F.when(x <= 5, 1).otherwise(0))


def bright_clip_ratio(px: Column | str = "px") -> Column:
    px = _c(px)
    return plane.mean(px, lambda x: F.when(x >= 250, 1).otherwise(0))


def global_contrast(px: Column | str = "px") -> Column:
    px = _c(px)
    return F.sqrt(plane.variance(px))


def local_contrast(px: Column | str = "px", h: Column | str = "h", w: Column | str = "w", side: int = 16) -> Column:
    px, h, w = _c(px), _c(h), _c(w)
    return plane.mean(F.transform(plane.tiles(px, h, w, side), lambda t: F.sqrt(plane.variance(t))))


def entropy(px: Column | str = "px") -> Column:
    """Bits, over the grey levels that occur."""
    px = _c(px)

    def part(v: Column) -> Column:
        p = F.size(F.filter(px, lambda x: x == v)) / F.size(px)
        return -p * F.log2(p)

    return F.aggregate(F.transform(F.array_distinct(px), part), F.lit(0.0), lambda a, x: a + x)


#: Second derivative over the four neighbours.
LAPLACIAN = ((-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4))


def sharpness(px: Column | str = "px", h: Column | str = "h", w: Column | str = "w") -> Column:
    px, h, w = _c(px), _c(h), _c(w)
    return plane.once(plane.weighted(px, h, w, LAPLACIAN), plane.variance)


def noise_estimate(px: Column | str = "px", h: Column | str = "h", w: Column | str = "w") -> Column:
    """Root mean square distance from the 3 x 3 median."""
    px, h, w = _c(px), _c(h), _c(w)
    gap = F.zip_with(px, transforms.median(px, h, w, 3), lambda a, b: a - b)
    return F.sqrt(plane.mean(gap, lambda d: d * d))


def illumination_kernel(h: int, w: int) -> int:
    k = min(51, max(3, min(h, w) // 4))
    return k + 1 - k % 2


def illumination_nonuniformity(kernel: int, px: Column | str = "px", h: Column | str = "h", w: Column | str = "w") -> Column:
    """Spread against mean of the smoothed image."""
    px, h, w = _c(px), _c(h), _c(w)

    def spread(p: Column) -> Column:
        m = plane.mean(p)
        return F.when(m <= 1e-9, 0.0).otherwise(F.sqrt(plane.variance(p)) / F.greatest(m, F.lit(1e-9)))

    return plane.once(transforms.gaussian(px, h, w, kernel), spread)


def colorfulness(b: Column, g: Column, r: Column) -> Column:
    """From the spreads and means of the absolute opponent differences."""
    rows = F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r"))
    rg = F.transform(rows, lambda s: F.abs(s.r - s.g))
    yb = F.transform(rows, lambda s: F.abs((s.r + s.g) * F.lit(0.5) - s.b))
    return F.sqrt(plane.variance(rg) + plane.variance(yb)) + 0.3 * F.sqrt(plane.mean(rg) * plane.mean(rg) + plane.mean(yb) * plane.mean(yb))


def saturation_plane(b: Column, g: Column, r: Column) -> Column:
    return F.transform(F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r")), lambda s: colour.saturation(s.b, s.g, s.r))


def saturation_spread(b: Column, g: Column, r: Column) -> Column:
    return F.sqrt(plane.variance(saturation_plane(b, g, r)))


def changes(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric: before, after, absolute_delta, percent_delta (null where before is all but 0).

    Both sides are unpivoted and joined on key and metric."""
    long = lambda df, name: df.unpivot(keys, metrics, "metric", name)
    return deltas(long(before, "before").join(long(after, "after"), [*keys, "metric"]))


def deltas(rows: DataFrame) -> DataFrame:
    """Rows with before and after, and how far they are apart."""
    delta = F.col("after") - F.col("before")
    return rows.withColumns({"absolute_delta": delta, "percent_delta": F.when(F.abs("before") >= 1e-9, delta / F.abs("before") * 100)})
