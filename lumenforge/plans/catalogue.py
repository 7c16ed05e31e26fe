"""All queries of the library on the standard tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour, plane
from ..operators import diagnostics as dx
from ..operators import cascade, features, kernels, learn, metrics, quantiles, scoring, split, text_checks
from ..operators import transforms as tx
from ..sources import rasters
from ..sources.shared import saved, settled
from . import advice, advisor, catalog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The rasters of sources.rasters as a grid of samples.
GRID = """
WITH e AS (SELECT vec_id AS image_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
px AS (SELECT image_id, label, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.6) / 1.2 * 255))) AS INT) AS g FROM e)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(c, 6)


# Metrics of images


@query(GRID + " SELECT image_id, round(avg(g), 6) AS mean_brightness FROM px GROUP BY image_id")
def mean_brightness(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", _r(dx.mean_brightness()).alias("mean_brightness"))


@query(GRID + " SELECT image_id, round(avg(CASE WHEN 3 * g - 255 <= 5 THEN 1.0 ELSE 0 END), 6) AS dark_clip_ratio, round(avg(CASE WHEN 3 * g - 255 >= 250 THEN 1.0 ELSE 0 END), 6) AS bright_clip_ratio FROM px GROUP BY image_id")
def clip_ratios(spark: SparkSession, d: str) -> DataFrame:
    """On stretched rasters, which are clipped at either end."""
    return rasters.stretched(rasters.load(spark, d)).select("image_id", _r(dx.dark_clip_ratio()).alias("dark_clip_ratio"), _r(dx.bright_clip_ratio()).alias("bright_clip_ratio"))


@query(GRID + " SELECT image_id, round(stddev_pop(g), 6) AS global_contrast FROM px GROUP BY image_id")
def global_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", _r(dx.global_contrast()).alias("global_contrast"))


@query(GRID + ", t AS (SELECT image_id, y // 4 AS ty, x // 4 AS tx, stddev_pop(g) AS s FROM px GROUP BY ALL) SELECT image_id, round(avg(s), 6) AS local_contrast FROM t GROUP BY image_id")
def local_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", _r(dx.local_contrast(side=4)).alias("local_contrast"))


@query(GRID + ", n AS (SELECT image_id, g, count(*) / 64.0 AS p FROM px GROUP BY ALL) SELECT image_id, round(-sum(p * log2(p)), 6) AS entropy FROM n GROUP BY image_id")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", _r(dx.entropy()).alias("entropy"))


def _near(border: str, offsets: list[tuple[int, int]], values: str = "px") -> str:
    """FROM clause that gathers the neighbours q of each sample p at offsets o (dy, dx, c)."""
    rows = ", ".join(f"({dy}, {dx_}, {i})" for i, (dy, dx_) in enumerate(offsets))
    at = {"reflect": "7 - abs(7 - abs(p.{0} + o.d{0}))", "replicate": "greatest(0, least(7, p.{0} + o.d{0}))"}[border]
    return f"{values} p CROSS JOIN (VALUES {rows}) o(dy, dx, i) JOIN {values} q ON q.image_id = p.image_id AND q.y = {at.format('y')} AND q.x = {at.format('x')}"


def _taps(taps, values: str = "px") -> tuple[str, str]:
    """FROM clause and weight expression for weighted neighbours."""
    weights = "CASE o.i " + " ".join(f"WHEN {i} THEN {float(t[2])!r}::DOUBLE" for i, t in enumerate(taps)) + " END"
    return _near("reflect", [t[:2] for t in taps], values), weights


def _weighted_sql(taps, expr: str, name: str, values: str = "px") -> str:
    src, w = _taps(taps, values)
    return f"{name} AS (SELECT p.image_id, p.y, p.x, any_value(p.g) AS g0, {expr.format(f'sum(q.g * {w})')} AS g FROM {src} GROUP BY p.image_id, p.y, p.x)"


_PLANE = " SELECT image_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY y, x) AS px FROM {0} GROUP BY image_id"


def _written(px: Column) -> Column:
    return F.array_join(px.cast("array<string>"), ",").alias("px")



@query(GRID + ", " + _weighted_sql(dx.LAPLACIAN, "{0}", "l") + " SELECT image_id, round(var_pop(g) * 4096) / 4096 AS sharpness FROM l GROUP BY image_id")
def sharpness(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", (F.round(dx.sharpness() * 4096) / 4096).alias("sharpness"))


_MEDIAN3 = f", m AS (SELECT p.image_id, p.y, p.x, any_value(p.g) AS g0, CAST(median(q.g) AS INT) AS g FROM {_near('replicate', plane.square(3))} GROUP BY p.image_id, p.y, p.x)"


@query(GRID + _MEDIAN3 + " SELECT image_id, round(sqrt(avg((g0 - g) * (g0 - g))), 6) AS noise_estimate FROM m GROUP BY image_id")
def noise_estimate(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", _r(dx.noise_estimate()).alias("noise_estimate"))


def _gauss_sql(k: int, sigma: float = 0.0) -> str:
    w = tx.gaussian_weights(k, sigma)
    across = _weighted_sql([(0, i - k // 2, c) for i, c in enumerate(w)], "{0}", "gx")
    down = _weighted_sql([(i - k // 2, 0, c) for i, c in enumerate(w)], "CAST(greatest(0, least(255, round_even(round({0}, 6), 0))) AS INT)", "gy", "gx")
    return f", {across}, {down}"


@query(GRID + _gauss_sql(3) + " SELECT image_id, round(stddev_pop(g) / avg(g), 6) AS illumination_nonuniformity FROM gy GROUP BY image_id")
def illumination_nonuniformity(spark: SparkSession, d: str) -> DataFrame:
    return rasters.load(spark, d).select("image_id", _r(dx.illumination_nonuniformity(dx.illumination_kernel(8, 8))).alias("illumination_nonuniformity"))


_BGR = ", c AS (SELECT image_id, y, x, g AS b, 255 - g AS gr, (g * 7) % 256 AS r FROM px)"


@query(GRID + _BGR + """, o AS (SELECT image_id, abs(r - gr) AS rg, abs(0.5::DOUBLE * (r + gr) - b) AS yb FROM c)
SELECT image_id, round(sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)), 6) AS colorfulness FROM o GROUP BY image_id""")
def colorfulness(spark: SparkSession, d: str) -> DataFrame:
    return rasters.coloured(rasters.load(spark, d)).select("image_id", _r(dx.colorfulness(F.col("b"), F.col("g"), F.col("r"))).alias("colorfulness"))


_SAT = ", s AS (SELECT *, CASE WHEN greatest(b, gr, r) = 0 THEN 0 ELSE CAST(round_even(255.0::DOUBLE * (greatest(b, gr, r) - least(b, gr, r)) / greatest(b, gr, r), 0) AS INT) END AS g FROM c)"


@query(GRID + _BGR + _SAT + " SELECT image_id, round(stddev_pop(g), 6) AS saturation_spread FROM s GROUP BY image_id")
def saturation_spread(spark: SparkSession, d: str) -> DataFrame:
    return rasters.coloured(rasters.load(spark, d)).select("image_id", _r(dx.saturation_spread(F.col("b"), F.col("g"), F.col("r"))).alias("saturation_spread"))


@query(GRID + _BGR + _SAT + _PLANE.format("s"))
def hsv_saturation(spark: SparkSession, d: str) -> DataFrame:
    return rasters.coloured(rasters.load(spark, d)).select("image_id", _written(dx.saturation_plane(F.col("b"), F.col("g"), F.col("r"))))


@query(GRID + _BGR + ", s AS (SELECT *, CAST(round_even(b * 0.114::DOUBLE + gr * 0.587::DOUBLE + r * 0.299::DOUBLE, 0) AS INT) AS g FROM c)" + _PLANE.format("s"))
def gray_bgr(spark: SparkSession, d: str) -> DataFrame:
    rows = F.arrays_zip("b", "g", "r")
    return rasters.coloured(rasters.load(spark, d)).select("image_id", _written(F.transform(rows, lambda s: colour.grey(s.b, s.g, s.r))))


# Transforms


def _plane(spark: SparkSession, d: str, f: Callable[..., Column], *args, dark: bool = False) -> DataFrame:
    images = rasters.load(spark, d)
    images = rasters.darkened(images) if dark else images
    return images.select("image_id", _written(f(F.col("px"), F.col("h"), F.col("w"), *args)))


_NORM = ", r AS (SELECT *, min(g) OVER (PARTITION BY image_id) AS lo, max(g) OVER (PARTITION BY image_id) AS hi FROM px), n AS (SELECT image_id, y, x, CASE WHEN hi = lo THEN 0 ELSE CAST(round_even((g - lo) * 255.0::DOUBLE / (hi - lo), 0) AS INT) END AS g FROM r)"


@query(GRID + _NORM + _PLANE.format("n"))
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.normalize)


_DARK = ", dk AS (SELECT image_id, y, x, g // 2 AS g FROM px)"
_GAMMA = ", mm AS (SELECT *, avg(g) OVER (PARTITION BY image_id) / 255 AS m FROM dk), gm AS (SELECT image_id, y, x, CASE WHEN m <= 1e-6 OR m >= 1 - 1e-6 THEN g ELSE CAST(floor(pow(g / 255.0::DOUBLE, greatest(0.5, least(2.0, ln(0.5) / ln(m)))) * 255 + 1e-9) AS INT) END AS g FROM mm)"


@query(GRID + _DARK + _GAMMA + _PLANE.format("gm"))
def auto_gamma(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.auto_gamma, dark=True)


@query(GRID + _gauss_sql(5, 0.8) + _PLANE.format("gy"))
def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.gaussian, 5, 0.8)


@query(GRID + _MEDIAN3 + _PLANE.format("m"))
def median_blur(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.median, 3)


_UNSHARP = _gauss_sql(5, 1.0) + ", u AS (SELECT p.image_id, p.y, p.x, CASE WHEN abs(p.g - s.g) < 3 THEN p.g ELSE CAST(greatest(0, least(255, round_even(round(p.g * 1.8::DOUBLE - s.g * 0.8::DOUBLE, 6), 0))) AS INT) END AS g FROM px p JOIN gy s USING (image_id, y, x))"


@query(GRID + _UNSHARP + _PLANE.format("u"))
def unsharp(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.unsharp, 5, 1.0, 0.8, 3)


def _morph(first: str, second: str, offsets: list[tuple[int, int]]) -> str:
    a = f"m1 AS (SELECT p.image_id, p.y, p.x, {first}(q.g) AS g FROM {_near('replicate', offsets)} GROUP BY p.image_id, p.y, p.x)"
    return f", {a}, m2 AS (SELECT p.image_id, p.y, p.x, {second}(q.g) AS g FROM {_near('replicate', offsets, 'm1')} GROUP BY p.image_id, p.y, p.x)"


@query(GRID + _morph("max", "min", plane.ellipse(5)) + ", bh AS (SELECT p.image_id, p.y, p.x, m2.g - p.g AS g FROM px p JOIN m2 USING (image_id, y, x))" + _PLANE.format("bh"))
def blackhat(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.blackhat, 5)


@query(GRID + _morph("min", "max", plane.ellipse(3)) + _PLANE.format("m2"))
def opening(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.opening, 3)


def _derivative_sql(taps) -> str:
    return GRID + ", " + _weighted_sql(taps, "CAST(least(255, abs({0})) AS INT)", "s") + _PLANE.format("s")


@query(_derivative_sql(tx.SOBEL))
def sobel(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.derivative, tx.SOBEL)


@query(_derivative_sql(tx.SCHARR))
def scharr(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.derivative, tx.SCHARR)


@query(_derivative_sql(tx.LAPLACIAN))
def laplacian(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.derivative, tx.LAPLACIAN)


@query(GRID + ", " + _weighted_sql(tx.gabor_taps(3), "CAST(greatest(0, least(255, round_even(round(abs({0}), 6), 0))) AS INT)", "s") + _PLANE.format("s"))
def gabor(spark: SparkSession, d: str) -> DataFrame:
    images = rasters.load(spark, d)
    response = plane.weighted(F.col("px"), F.col("h"), F.col("w"), tx.gabor_taps(3))
    return images.select("image_id", _written(F.transform(response, lambda v: plane.byte(F.round(F.abs(v), 6)))))


def _bilateral_sql(diameter: int, colour_: float, space: float) -> str:
    r = diameter // 2
    disc = [(dy, x) for dy, x in plane.square(2 * r + 1) if dy * dy + x * x <= r * r]
    far = "CASE o.i " + " ".join(f"WHEN {i} THEN {-(dy * dy + x * x) / (2.0 * space**2)!r}::DOUBLE" for i, (dy, x) in enumerate(disc)) + " END"
    weight = f"exp({far} - 9 * (q.g - p.g) * (q.g - p.g) / {2.0 * colour_**2}::DOUBLE)"
    return f", bl AS (SELECT p.image_id, p.y, p.x, CAST(round_even(round(sum({weight} * q.g) / sum({weight}), 6), 0) AS INT) AS g FROM {_near('reflect', disc)} GROUP BY p.image_id, p.y, p.x)"


@query(GRID + _bilateral_sql(7, 45, 45) + _PLANE.format("bl"))
def bilateral_blur(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.bilateral, 7, 45.0, 45.0)


#: Cells of 4 x 4 samples, of which each level counts twice at most.
_CLAHE = """, n AS (SELECT image_id, y // 4 * 2 + x // 4 AS cell, g AS v, count(*) AS n FROM px GROUP BY ALL), k AS (SELECT DISTINCT image_id, cell FROM n),
c AS (SELECT image_id, cell, v, coalesce(n, 0) AS n FROM k CROSS JOIN (SELECT CAST(unnest(range(256)) AS INT) AS v) LEFT JOIN n USING (image_id, cell, v)),
ex AS (SELECT *, CAST(sum(greatest(n - 2, 0)) OVER (PARTITION BY image_id, cell) AS INT) AS excess FROM c),
h AS (SELECT image_id, cell, v, least(n, 2) + excess // 256 + CASE WHEN excess % 256 > 0 AND v % greatest(1, 256 // greatest(excess % 256, 1)) = 0 AND v // greatest(1, 256 // greatest(excess % 256, 1)) < excess % 256 THEN 1 ELSE 0 END AS n FROM ex),
t AS (SELECT image_id, cell, v, least(255, round_even(sum(n) OVER (PARTITION BY image_id, cell ORDER BY v) * 255.0::DOUBLE / 16, 0)) AS level FROM h),
s AS (SELECT *, (y + 0.5::DOUBLE) / 4 - 0.5 AS fy, (x + 0.5::DOUBLE) / 4 - 0.5 AS fx FROM px),
o AS (SELECT s.*, CAST(greatest(0, least(1, floor(fy) + dy)) * 2 + greatest(0, least(1, floor(fx) + dx)) AS INT) AS cell, abs(1 - dy - (fy - floor(fy))) * abs(1 - dx - (fx - floor(fx))) AS share FROM s CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) z(dy, dx)),
cl AS (SELECT o.image_id, o.y, o.x, CAST(round_even(round(sum(t.level * o.share), 6), 0) AS INT) AS g FROM o JOIN t ON t.image_id = o.image_id AND t.cell = o.cell AND t.v = o.g GROUP BY ALL)"""


@query(GRID + _CLAHE + _PLANE.format("cl"))
def clahe(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d, tx.clahe, 40.0, 2)


def _canny_sql(low: str, high: str) -> str:
    """CTEs with the edges `ed` (image_id, y, x) and the reach of each among them, by recursive queries."""
    sector = "CASE WHEN a < 22.5 OR a >= 157.5 THEN [0, 1] WHEN a < 67.5 THEN [1, 1] WHEN a < 112.5 THEN [1, 0] ELSE [1, -1] END"
    taps = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
    gx, gy = ("CASE o.i " + " ".join(f"WHEN {i} THEN {(x if s else y) * (2 if 0 in (y, x) else 1)}" for i, (y, x) in enumerate(taps)) + " ELSE 0 END" for s in (1, 0))
    return f""", th AS (SELECT image_id, {low} AS low, {high} AS high FROM (SELECT image_id, median(g) AS m FROM px GROUP BY image_id)),
gr AS (SELECT p.image_id, p.y, p.x, CAST(sum(q.g * {gx}) AS INT) AS dx, CAST(sum(q.g * {gy}) AS INT) AS dy FROM {_near('reflect', list(taps))} GROUP BY p.image_id, p.y, p.x),
ma AS (SELECT image_id, y, x, abs(dx) + abs(dy) AS mag, {sector} AS d FROM (SELECT *, (degrees(atan2(dy, dx)) + 360) % 180 AS a FROM gr)),
ri AS (SELECT m.image_id, m.y, m.x, m.mag > greatest(low, high) AS strong FROM ma m JOIN th USING (image_id) LEFT JOIN ma b ON b.image_id = m.image_id AND b.y = m.y - m.d[1] AND b.x = m.x - m.d[2] LEFT JOIN ma c ON c.image_id = m.image_id AND c.y = m.y + m.d[1] AND c.x = m.x + m.d[2]
       WHERE m.mag > low AND m.mag > coalesce(b.mag, 0) AND m.mag >= coalesce(c.mag, 0)),
ed AS (SELECT image_id, y, x FROM ri WHERE strong UNION SELECT r.image_id, r.y, r.x FROM ed e JOIN ri r ON r.image_id = e.image_id AND abs(r.y - e.y) <= 1 AND abs(r.x - e.x) <= 1),
re AS (SELECT image_id, y, x, y AS ty, x AS tx FROM ed UNION SELECT e.image_id, e.y, e.x, r.ty, r.tx FROM re r JOIN ed e ON e.image_id = r.image_id AND abs(r.y - e.y) <= 1 AND abs(r.x - e.x) <= 1)"""


_RECURSIVE = GRID.replace("WITH e AS", "WITH RECURSIVE e AS", 1)


@query(_RECURSIVE + _canny_sql("50", "150") + ", ce AS (SELECT p.image_id, p.y, p.x, CASE WHEN e.y IS NULL THEN 0 ELSE 255 END AS g FROM px p LEFT JOIN ed e USING (image_id, y, x))" + _PLANE.format("ce"))
def canny(spark: SparkSession, d: str) -> DataFrame:
    edges = lambda img: [{"px": ",".join(map(str, (kernels.canny(kernels.grey(img), 50, 150) * 255).ravel().tolist()))}]
    return kernels.map_images(_as_images(spark, d, 1), ["image_id"], edges, "px string")


@query(_RECURSIVE + _canny_sql("CAST(floor(0.66::DOUBLE * m) AS INT)", "CAST(floor(least(255, greatest(floor(0.66::DOUBLE * m) + 1, 1.33::DOUBLE * m))) AS INT)") + """, sz AS (SELECT image_id, y, x, count(*) AS n FROM re GROUP BY ALL)
SELECT i.image_id, round(count(n) / 64.0::DOUBLE, 6) AS edge_density, round(CASE WHEN count(n) = 0 THEN 0 ELSE CAST(count(n) FILTER (n >= 8) AS DOUBLE) / count(n) END, 6) AS edge_continuity FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN sz USING (image_id) GROUP BY i.image_id""")
def edge_measures(spark: SparkSession, d: str) -> DataFrame:
    names = ("edge_density", "edge_continuity")
    found = kernels.map_images(_as_images(spark, d, 1), ["image_id"], lambda img: [dict(zip(names, map(float, kernels.edge_metrics(kernels.grey(img))), strict=True))], "edge_density double, edge_continuity double")
    return found.select("image_id", *[_r(c).alias(c) for c in names])


# All rasters side by side, as one image that is larger than a row


_STRIP = GRID + ", st AS (SELECT image_id, y, CAST(image_id * 8 + x AS BIGINT) AS x, g FROM px)"


def _strip(spark: SparkSession, d: str) -> DataFrame:
    """The table's rasters as the tiles of one image, from left to right by id. Ids run from 0 without gaps."""
    images = rasters.load(spark, d)
    n = images.agg(F.max("image_id")).first()[0]
    whole = {"strip": 0, "ty": 0, "top": 0, "rows": rasters.SIDE, "cols": rasters.SIDE, "height": rasters.SIDE, "width": rasters.SIDE * ((n or 0) + 1)}
    hexes = F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0"))
    place = {"tx": F.col("image_id").cast("int"), "left": (F.col("image_id") * rasters.SIDE).cast("int"), "data": F.unhex(F.array_join(hexes, ""))}
    return images.select("image_id", *[F.lit(v).alias(k) for k, v in whole.items()], *[v.alias(k) for k, v in place.items()])


def _strip_gauss() -> str:
    """Of a separable filter, first across the seams, then down; the strip mirrors at its two ends only."""
    w = tx.gaussian_weights(5, 0.8)
    weight = "CASE o.d " + " ".join(f"WHEN {i - 2} THEN {c!r}::DOUBLE" for i, c in enumerate(w)) + " END"
    offsets = "(VALUES (-2), (-1), (0), (1), (2)) o(d)"
    return f""", m AS (SELECT max(x) AS last FROM st),
a AS (SELECT p.image_id, p.y, p.x, sum(q.g * {weight}) AS g FROM st p CROSS JOIN m CROSS JOIN {offsets} JOIN st q ON q.y = p.y AND q.x = m.last - abs(m.last - abs(p.x + o.d)) GROUP BY p.image_id, p.y, p.x),
b AS (SELECT p.image_id, p.y, p.x, CAST(greatest(0, least(255, round_even(round(sum(q.g * {weight}), 6), 0))) AS INT) AS g FROM a p CROSS JOIN {offsets} JOIN a q ON q.x = p.x AND q.y = 7 - abs(7 - abs(p.y + o.d)) GROUP BY p.image_id, p.y, p.x)"""


@query(_STRIP + _strip_gauss() + _PLANE.format("b"))
def tiled_blur(spark: SparkSession, d: str) -> DataFrame:
    """A filter over the seams of tiles."""
    from ..operators import tiles

    done = tiles.local(_strip(spark, d), ["strip"], 2, lambda x: kernels.gaussian(x[..., 0], 5, 0.8)[..., None])
    return done.select(F.col("tx").cast("long").alias("image_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(rasters.SIDE**2)), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10)), ",").alias("px"))


@query(_STRIP.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, k AS (SELECT y, x, y * (1 + (SELECT max(x) FROM st)) + x + 1 AS p FROM st WHERE g > 150),
r AS (SELECT y, x, p, p AS root FROM k UNION SELECT k.y, k.x, k.p, r.root FROM r JOIN k ON abs(k.y - r.y) <= 1 AND k.x BETWEEN r.x - 1 AND r.x + 1 AND r.root < k.p)
SELECT root AS component, count(*) AS samples FROM (SELECT p, min(root) AS root FROM r GROUP BY p) GROUP BY root""")
def tiled_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected bright samples over the seams of tiles."""
    from ..operators import tiles

    masks = tiles.local(_strip(spark, d), ["strip"], 0, lambda x: (x > 150).astype(np.uint8))
    return tiles.component_sizes(masks, ["strip"]).select("component", "samples")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, v, n): the histogram, at most 256 rows for an image after map-side counts."""
    return rasters.load(spark, d).select("image_id", F.explode("px").alias("v")).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


_EQ = ", n AS (SELECT image_id, g, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cdf, first_value(n) OVER w AS low, sum(n) OVER (PARTITION BY image_id) AS total FROM n WINDOW w AS (PARTITION BY image_id ORDER BY g))"


@query(GRID + _EQ + " SELECT image_id, g AS v, CASE WHEN low = total THEN g ELSE CAST(round_even((cdf - low) * 255.0::DOUBLE / (total - low), 0) AS INT) END AS equalized FROM c")
def hist_equalize(spark: SparkSession, d: str) -> DataFrame:
    """The table of grey levels of each image."""
    w = W.partitionBy("image_id").orderBy("v")
    t = _levels(spark, d).withColumns({"cdf": F.sum("n").over(w), "low": F.first("n").over(w), "total": F.sum("n").over(W.partitionBy("image_id"))})
    out = F.when(F.col("low") == F.col("total"), F.col("v")).otherwise(F.bround((F.col("cdf") - F.col("low")) * F.lit(255.0) / F.greatest(F.col("total") - F.col("low"), F.lit(1)), 0).cast("int"))
    return t.select("image_id", "v", out.alias("equalized"))


@query(GRID + """, n AS (SELECT image_id, g, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT image_id, g, sum(n) OVER w AS w0, sum(n * g) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * g) OVER (PARTITION BY image_id) AS s FROM n WINDOW w AS (PARTITION BY image_id ORDER BY g)),
b AS (SELECT image_id, g, CASE WHEN w > w0 THEN round(CAST(w0 AS DOUBLE) * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 3) ELSE 0 END AS v FROM c)
SELECT image_id, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, g) AS r FROM b) WHERE r = 1""")
def otsu(spark: SparkSession, d: str) -> DataFrame:
    w, every = W.partitionBy("image_id").orderBy("v"), W.partitionBy("image_id")
    t = _levels(spark, d).withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("v")).over(w), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("v")).over(every)})
    rest = F.greatest(F.col("w") - F.col("w0"), F.lit(1))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / rest
    between = F.when(F.col("w") > F.col("w0"), F.round(F.col("w0").cast("double") * rest * F.pow(gap, F.lit(2)), 3)).otherwise(0.0)
    best = t.select("image_id", F.col("v").alias("threshold"), between.alias("b"))
    return best.groupBy("image_id").agg(F.max_by("threshold", F.struct(F.col("b"), (-F.col("threshold")))).alias("threshold"))


# Advice: candidates, scores, ranks

_ADVICE_SQL = advice.sql(GRID, _NORM, _DARK, _GAMMA)


@query(_ADVICE_SQL + " SELECT image_id, pipeline_id, metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS absolute_delta, round(CASE WHEN abs(before) >= 1e-9 THEN (after - before) / abs(before) * 100 END, 4) AS percent_delta FROM pairs")
def metric_changes(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"before_{m}").alias("before"), F.col(f"after_{m}").alias("after")) for m in advice.METRICS])
    rows = dx.deltas(advice.candidates(spark, d).select("image_id", "pipeline_id", F.inline(both)))
    return rows.select("image_id", "pipeline_id", "metric", _r("before").alias("before"), _r("after").alias("after"), _r("absolute_delta").alias("absolute_delta"), F.round("percent_delta", 4).alias("percent_delta"))


@query(_ADVICE_SQL + advice.SCORE_SQL + " SELECT image_id, pipeline_id, metric, round(value, 6) AS value, weight, round(value * weight, 6) AS weighted FROM comps")
def component_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = advice.scored(spark, d).select("image_id", "pipeline_id", F.inline("parts"))
    return rows.select("image_id", "pipeline_id", "metric", _r("value").alias("value"), "weight", _r(F.col("value") * F.col("weight")).alias("weighted"))


@query(_ADVICE_SQL + advice.SCORE_SQL + " SELECT image_id, pipeline_id, round(score, 6) AS score FROM totals")
def weighted_total(spark: SparkSession, d: str) -> DataFrame:
    return advice.scored(spark, d).select("image_id", "pipeline_id", _r("score").alias("score"))


@query(_ADVICE_SQL + advice.SCORE_SQL + " SELECT image_id, pipeline_id, warnings FROM warned")
def warnings(spark: SparkSession, d: str) -> DataFrame:
    return advice.scored(spark, d).select("image_id", "pipeline_id", F.array_join("warnings", ",").alias("warnings"))


@query(_ADVICE_SQL + advice.SCORE_SQL + " SELECT image_id, pipeline_id, reason_no, reason FROM reasons")
def top2_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = advice.scored(spark, d).select("image_id", "pipeline_id", F.posexplode("reasons").alias("n", "reason"))
    return rows.select("image_id", "pipeline_id", (F.col("n") + 1).cast("long").alias("reason_no"), "reason")


@query(_ADVICE_SQL + advice.SCORE_SQL + """ SELECT image_id, rank, pipeline_id, round(score, 6) AS score, warnings, reasons FROM (
SELECT image_id, pipeline_id, score, warnings, n_warnings, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 6) DESC, n_warnings, pipeline_id) AS rank FROM totals JOIN warned USING (image_id, pipeline_id))
JOIN (SELECT image_id, pipeline_id, string_agg(reason, '; ' ORDER BY reason_no) AS reasons FROM reasons GROUP BY ALL) USING (image_id, pipeline_id) WHERE rank <= 3""")
def top3_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return advice.recommendations(spark, d)


#: Figures with all metrics before and after, from the values of embeddings: metric, scale of its values.
_FIGURES = {
    "mean_brightness": 400.0, "dark_clip_ratio": 0.1, "bright_clip_ratio": 0.1, "local_contrast": 100.0, "entropy": 10.0, "sharpness": 900.0, "noise_estimate": 30.0,
    "edge_density": 1.5, "edge_continuity": 2.0, "colorfulness": 150.0, "saturation_spread": 200.0,
}


def _figures(spark: SparkSession, d: str) -> DataFrame:
    value = lambda i, scale: F.abs(F.get("embedding", F.lit(i)).cast("double")) * F.lit(scale)
    both = {f"{side}_{m}": value(i + (20 if side == "after" else 0), scale) for i, (m, scale) in enumerate(_FIGURES.items()) for side in ("before", "after")}
    return _table(spark, d, "embeddings").select("vec_id", "label", *[v.alias(k) for k, v in both.items()])


_IMPROVED = {"local_contrast": 50, "entropy": 40, "sharpness": 35, "edge_continuity": 50, "saturation_spread": 35}


def _figures_sql() -> str:
    """CTEs `parts` (vec_id, label, profile, metric, value, weight), `totals`, `warned` and `best` for the SQL of the queries."""
    own = ", ".join(f"abs(CAST(embedding[{i + 1 + off}] AS DOUBLE)) * {scale}::DOUBLE AS {side}_{m}" for i, (m, scale) in enumerate(_FIGURES.items()) for side, off in (("b", 0), ("a", 20)))
    clip = lambda x: f"greatest(0::DOUBLE, least(100::DOUBLE, {x}))"
    better = lambda b, a, scale: clip(f"50 + ({a} - {b}) / greatest(abs({b}), 1e-9) * {scale}")
    values = {("saturation_separation" if m == "saturation_spread" else m): better(f"b_{m}", f"a_{m}", k) for m, k in _IMPROVED.items()}
    edges = better("b_edge_density", "a_edge_density", 35)
    values["edge_density"] = f"CASE WHEN a_edge_density > greatest(0.25, b_edge_density * 2.5) THEN {edges} / 2 ELSE {edges} END"
    values["noise_reduction"] = better("b_noise_estimate", "(2 * b_noise_estimate - a_noise_estimate)", 50)
    values["clipping_control"] = clip("100 - 500 * (a_dark_clip_ratio + a_bright_clip_ratio)")
    values["exposure_balance"] = clip("100 - abs(a_mean_brightness - 127.5) / 127.5 * 100")
    kept = clip("100 - abs(a_colorfulness - b_colorfulness) / greatest(abs(b_colorfulness), 1e-9) * 100")
    values["color_preservation"] = f"CASE WHEN abs(b_colorfulness) >= 1e-9 THEN {kept} WHEN abs(a_colorfulness) < 1e-9 THEN 100 ELSE 50 END"
    named = " UNION ALL ".join(f"SELECT vec_id, label, '{m}' AS metric, {v} AS value FROM f" for m, v in values.items())
    weights = ", ".join(f"('{p}', '{m}', {w}::DOUBLE)" for p, own_ in catalog.WEIGHTS.items() for m, w in own_.items())
    clips = "(a_dark_clip_ratio + a_bright_clip_ratio - b_dark_clip_ratio - b_bright_clip_ratio > 0.01 OR a_dark_clip_ratio + a_bright_clip_ratio > 0.05)"
    rules = (("clipping", clips), ("excessive_edges", "a_edge_density > greatest(0.25, b_edge_density * 2.5)"), ("oversmoothing", "b_sharpness > 1e-9 AND a_sharpness < b_sharpness * 0.5"), ("color_loss", "b_colorfulness > 1e-9 AND a_colorfulness < b_colorfulness * 0.5"))
    told = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules)
    return f"""WITH f AS (SELECT vec_id, label, {own} FROM embeddings), vals AS ({named}), w AS (SELECT * FROM (VALUES {weights}) t(profile, metric, weight)),
parts AS (SELECT vec_id, label, profile, metric, value, weight FROM vals JOIN w USING (metric)),
totals AS (SELECT vec_id, label, profile, greatest(0, least(100, sum(value * weight))) AS score FROM parts GROUP BY ALL),
warned AS (SELECT vec_id, concat_ws(',', {told}) AS warnings, len(list_filter([{told}], lambda x: x IS NOT NULL)) AS n FROM f),
why AS (SELECT vec_id, profile, metric || CASE WHEN value > 52 THEN ' improved' WHEN value < 48 THEN ' declined' ELSE ' unchanged' END AS reason, row_number() OVER (PARTITION BY vec_id, profile ORDER BY round(value, 6) DESC, metric) AS no FROM parts),
reasons AS (SELECT vec_id, profile, string_agg(reason, '; ' ORDER BY no) AS reasons FROM why WHERE no <= 2 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY label, profile ORDER BY round(score, 6) DESC, n, vec_id % 7, CAST(vec_id AS VARCHAR)) AS rank FROM totals JOIN warned USING (vec_id) JOIN reasons USING (vec_id, profile))"""


def _scored(spark: SparkSession, d: str, profile: str) -> DataFrame:
    return scoring.scored(_figures(spark, d), catalog.WEIGHTS[profile]).withColumn("profile", F.lit(profile))


def _of_profiles(f: Callable[[str], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(f, catalog.PROFILES))


@query(_figures_sql() + " SELECT vec_id, profile, metric, round(value, 6) AS value, weight FROM parts")
def score_parts(spark: SparkSession, d: str) -> DataFrame:
    """All ten components, by profile."""
    return _of_profiles(lambda p: _scored(spark, d, p).select("vec_id", "profile", F.inline("parts"))).withColumn("value", _r("value"))


@query(_figures_sql() + " SELECT vec_id, warnings FROM warned")
def score_warnings(spark: SparkSession, d: str) -> DataFrame:
    """All four rules."""
    return _scored(spark, d, "auto").select("vec_id", F.array_join("warnings", ",").alias("warnings"))


@query(_figures_sql() + " SELECT label, profile, rank, vec_id, round(score, 6) AS score, warnings, reasons FROM best WHERE rank <= 3")
def score_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The three best of each label, with scores, warnings and reasons, by profile."""
    timed = lambda p: _scored(spark, d, p).withColumns({"processing_ms": (F.col("vec_id") % 7).cast("double"), "pipeline_id": F.col("vec_id").cast("string")})
    return _of_profiles(lambda p: scoring.ranked(timed(p), ["label"]).select("label", "profile", F.col("rank").cast("long").alias("rank"), "vec_id", _r("score").alias("score"), F.array_join("warnings", ",").alias("warnings"), F.array_join("reasons", "; ").alias("reasons")))


_PROFILED = "WITH i AS (SELECT vec_id AS image_id, ['auto', 'shape', 'color', 'texture'][label % 4 + 1] AS profile FROM embeddings)"


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, profile): a task for each raster, by its label."""
    profile = F.get(F.array(*map(F.lit, catalog.PROFILES)), (F.col("label") % len(catalog.PROFILES)).cast("int"))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), profile.alias("profile"))


@query(_PROFILED + ", p AS (SELECT * FROM (VALUES " + ", ".join(f"('{p.id}', '{q}')" for p in catalog.DEFAULT for q in p.profiles) + ") t(pipeline_id, profile)) SELECT image_id, profile, pipeline_id FROM i JOIN p USING (profile)")
def profile_filter(spark: SparkSession, d: str) -> DataFrame:
    """The pipelines that suit each raster's task."""
    table = catalog.pipelines_table(spark).select("pipeline_id", F.explode("profiles").alias("profile"))
    return _profiled(spark, d).join(F.broadcast(table), "profile").select("image_id", "profile", "pipeline_id")


@query(_PROFILED + ", w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', {v}::DOUBLE)" for p, own in catalog.WEIGHTS.items() for m, v in own.items()) + ") t(profile, metric, weight)) SELECT image_id, profile, round(sum(weight), 6) AS total, count(*) AS n, abs(sum(weight) - 1) <= 1e-9 AS valid FROM i JOIN w USING (profile) GROUP BY ALL")
def weight_validation(spark: SparkSession, d: str) -> DataFrame:
    """The weights by which each raster is scored: their number, and whether their sum is 1."""
    both = _profiled(spark, d).join(F.broadcast(catalog.weights_table(spark).select("profile", "weight")), "profile")
    sums = both.groupBy("image_id", "profile").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select("image_id", "profile", _r("total").alias("total"), "n", (F.abs(F.col("total") - 1) <= 1e-9).alias("valid"))


_SETS = """WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT *, sum(v) OVER (PARTITION BY vec_id) AS total FROM u WHERE pos < 6),
w AS (SELECT vec_id, ['auto', 'shape', 'color', 'texture', 'depth'][label % 5 + 1] AS profile, CASE WHEN vec_id % 11 = pos THEN 'glow' ELSE ['entropy', 'sharpness', 'local_contrast', 'edge_density', 'noise_reduction', 'clipping_control'][pos + 1] END AS metric, CASE WHEN vec_id % 13 = pos THEN -v WHEN vec_id % 3 = 0 THEN v ELSE v / total END AS weight FROM s)"""


@query(_SETS + """, f AS (SELECT vec_id, any_value(profile) = 'depth' AS profile, bool_or(metric = 'glow') AS metric, bool_or(weight < 0) AS number, abs(sum(weight) - 1) > 1e-9 AS sum FROM w GROUP BY vec_id)
SELECT vec_id, concat_ws(',', CASE WHEN profile THEN 'profile' END, CASE WHEN metric THEN 'metric' END, CASE WHEN number THEN 'number' END, CASE WHEN sum THEN 'sum' END) AS faults FROM f""")
def weight_sets(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with sets of weights, one from each vector."""
    names = ["entropy", "sharpness", "local_contrast", "edge_density", "noise_reduction", "clipping_control"]
    v = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    total = sum((v(i) for i in range(1, 6)), v(0))
    weight = lambda i: F.when(F.col("vec_id") % 13 == i, -v(i)).when(F.col("vec_id") % 3 == 0, v(i)).otherwise(v(i) / total)
    profile = F.get(F.array(*[F.lit(p) for p in (*catalog.PROFILES, "depth")]), (F.col("label") % 5).cast("int"))
    rows = _table(spark, d, "embeddings").select("vec_id", profile.alias("profile"), F.inline(F.array(*[F.struct(F.when(F.col("vec_id") % 11 == i, "glow").otherwise(n).alias("metric"), weight(i).alias("weight")) for i, n in enumerate(names)])))
    return catalog.faults_of_sets(rows, ["vec_id"]).select("vec_id", F.array_join("faults", ",").alias("faults"))


# Folds, learners, metrics

_ORDER = "md5('42:' || CAST(vec_id AS VARCHAR)), vec_id"
_FOLDS = f"WITH f AS (SELECT vec_id, label, embedding, ntile(5) OVER (PARTITION BY label ORDER BY {_ORDER}) - 1 AS fold FROM embeddings)"


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_folds(_table(spark, d, "embeddings"), "vec_id", "label")


@query(_FOLDS + " SELECT vec_id, label, fold FROM f")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("vec_id", "label", F.col("fold").cast("long").alias("fold"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """The largest class first."""
    return _table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


_Z = _FOLDS + """, k AS (SELECT unnest(range(5)) AS test_fold), u AS (SELECT vec_id, label, fold, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM f),
st AS (SELECT test_fold, pos, avg(CAST(x AS DOUBLE)) AS m, CASE WHEN stddev_pop(CAST(x AS DOUBLE)) < 1e-8 THEN 1.0 ELSE stddev_pop(CAST(x AS DOUBLE)) END AS sd FROM u JOIN k ON fold <> test_fold GROUP BY ALL),
z AS (SELECT test_fold, vec_id, label, fold, pos, (CAST(x AS DOUBLE) - m) / sd AS z FROM u JOIN st USING (pos))"""


@query(_Z + " SELECT test_fold, vec_id, round(sum(z), 4) AS z_sum, round(sum(z * z), 4) AS z_square FROM z GROUP BY ALL")
def fold_standardize(spark: SparkSession, d: str) -> DataFrame:
    z = learn.standardize(_folded(spark, d), features="embedding")
    total = lambda f: F.round(F.aggregate("z", F.lit(0.0), lambda s, v: s + f(v)), 4)
    return z.select(F.col("test_fold").cast("long").alias("test_fold"), "vec_id", total(lambda v: v).alias("z_sum"), total(lambda v: v * v).alias("z_square"))


_KNN = _Z + """, v AS (SELECT test_fold, vec_id, label, fold, list(z ORDER BY pos) AS z FROM z GROUP BY ALL),
dist AS (SELECT a.test_fold, a.vec_id, a.label AS actual, b.vec_id AS other, b.label AS vote, round(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM v a JOIN v b ON a.test_fold = b.test_fold AND a.fold = a.test_fold AND b.fold <> b.test_fold),
near AS (SELECT *, row_number() OVER (PARTITION BY test_fold, vec_id ORDER BY d, other) AS place FROM dist),
votes AS (SELECT test_fold, vec_id, actual, vote, count(*) AS n, sum(place) AS places FROM near WHERE place <= 5 GROUP BY ALL),
pred AS (SELECT test_fold, vec_id, actual, vote AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY test_fold, vec_id ORDER BY n DESC, places, vote) AS r FROM votes) WHERE r = 1)"""


@query(_KNN + " SELECT test_fold, vec_id, actual, predicted FROM pred")
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    return learn.knn_across(_folded(spark, d), "vec_id", "label", features="embedding").withColumn("test_fold", F.col("test_fold").cast("long"))


_PRED = "WITH pr AS (SELECT CAST(doc_id % 3 AS INT) AS fold, lang AS pipeline_id, quality AS actual, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)), cl AS (SELECT unnest([0, 1]) AS c)"
_CM = _PRED + """, cm AS (SELECT k.pipeline_id, k.fold, a.c AS actual, p.c AS predicted, count(pr.actual) AS n FROM (SELECT DISTINCT pipeline_id, fold FROM pr) k CROSS JOIN cl a CROSS JOIN cl p
LEFT JOIN pr ON pr.pipeline_id = k.pipeline_id AND pr.fold = k.fold AND pr.actual = a.c AND pr.predicted = p.c GROUP BY ALL)"""
_PC = _CM + """, pc0 AS (SELECT pipeline_id, fold, c AS class_index, CAST(sum(CASE WHEN actual = c AND predicted = c THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN actual = c THEN n ELSE 0 END) AS BIGINT) AS support, sum(CASE WHEN predicted = c THEN n ELSE 0 END) AS called FROM cm CROSS JOIN cl GROUP BY ALL),
pc1 AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE tp / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM pc0),
pc AS (SELECT pipeline_id, fold, class_index, support, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc1)"""
_MM = _PC + """, mm AS (SELECT pipeline_id, fold, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM pc GROUP BY ALL),
ac AS (SELECT pipeline_id, fold, CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS accuracy FROM cm GROUP BY ALL), fm AS (SELECT * FROM mm JOIN ac USING (pipeline_id, fold))"""
_FS = _MM + """, fs AS (SELECT pipeline_id, avg(accuracy) AS mean_accuracy, coalesce(stddev_samp(accuracy), 0) AS std_accuracy, avg(macro_f1) AS mean_macro_f1, coalesce(stddev_samp(macro_f1), 0) AS std_macro_f1, avg(macro_precision) AS mean_macro_precision, avg(macro_recall) AS mean_macro_recall FROM fm GROUP BY pipeline_id)"""


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Quality of documents against a rule on their length, by language and fold."""
    rule = F.when(F.col("n_chars") >= 400, 1).otherwise(0)
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select((F.col("doc_id") % 3).cast("int").alias("fold"), F.col("lang").alias("pipeline_id"), F.col("quality").alias("actual"), rule.alias("predicted"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(0,), (1,)], "class_index int")
    return metrics.confusion(_predictions(spark, d), classes, ["pipeline_id", "fold"])


@query(_CM + " SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(_PC + " SELECT pipeline_id, fold, class_index, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.per_class(_matrix(spark, d), ["pipeline_id", "fold"])
    return rows.select("pipeline_id", "fold", "class_index", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_MM + " SELECT pipeline_id, fold, round(accuracy, 6) AS accuracy, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1 FROM fm")
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.macro(_matrix(spark, d), ["pipeline_id", "fold"])
    return rows.select("pipeline_id", "fold", *[_r(c).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


_STATS = ("mean_accuracy", "std_accuracy", "mean_macro_f1", "std_macro_f1", "mean_macro_precision", "mean_macro_recall")
_STATS_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _STATS)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return metrics.over_folds(metrics.macro(_matrix(spark, d), ["pipeline_id", "fold"]), ["pipeline_id"])


@query(_FS + f" SELECT pipeline_id, {_STATS_SQL} FROM fs")
def fold_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("pipeline_id", *[_r(c).alias(c) for c in _STATS])


#: Predictions of nearest neighbours on the samples of every raster after each of three pipelines, for the board of entries.
_FITTED = GRID + _NORM + _GAMMA.replace("FROM dk)", "FROM px)", 1).replace("mm AS", "br AS", 1).replace("FROM mm)", "FROM br)", 1) + f""", fo AS (SELECT vec_id, ntile(5) OVER (PARTITION BY label ORDER BY {_ORDER}) - 1 AS fold FROM embeddings),
sm AS (SELECT 'original' AS pipeline_id, image_id, y, x, g FROM px UNION ALL SELECT 'baseline-normalize', image_id, y, x, g FROM n UNION ALL SELECT 'auto-gamma', image_id, y, x, g FROM gm),
u AS (SELECT pipeline_id, image_id AS vec_id, y * 8 + x AS pos, CAST(g AS DOUBLE) AS v, fold FROM sm JOIN fo ON fo.vec_id = image_id), tf AS (SELECT unnest(range(5)) AS test_fold),
sd AS (SELECT pipeline_id, test_fold, pos, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END AS s FROM u JOIN tf ON fold <> test_fold GROUP BY ALL),
zs AS (SELECT pipeline_id, test_fold, vec_id, fold, list((v - m) / s ORDER BY pos) AS z FROM u JOIN sd USING (pipeline_id, pos) GROUP BY ALL),
ds AS (SELECT a.pipeline_id, a.test_fold, a.vec_id, b.vec_id AS other, round(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM zs a JOIN zs b ON a.pipeline_id = b.pipeline_id AND a.test_fold = b.test_fold AND a.fold = a.test_fold AND b.fold <> b.test_fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id, vec_id ORDER BY d, other) AS place FROM ds),
vt AS (SELECT pipeline_id, test_fold, nn.vec_id, e2.label AS vote, count(*) AS n, sum(place) AS places FROM nn JOIN embeddings e2 ON e2.vec_id = nn.other WHERE place <= 5 GROUP BY ALL),
bv AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id, vec_id ORDER BY n DESC, places, vote) AS r FROM vt),
pr AS (SELECT test_fold AS fold, pipeline_id, e3.label AS actual, vote AS predicted FROM bv JOIN embeddings e3 USING (vec_id) WHERE r = 1), cl AS (SELECT DISTINCT label AS c FROM embeddings)"""
_LB = _FS.replace(_PRED, _FITTED, 1) + """, lb AS (SELECT *, 'knn' AS classifier, row_number() OVER (ORDER BY round(mean_macro_f1, 6) DESC, round(mean_accuracy, 6) DESC, pipeline_id) AS rank FROM fs)"""


def _board(spark: SparkSession, d: str) -> DataFrame:
    """Entries of nearest neighbours on the rasters after each of three pipelines. Of a pipeline only the predictions stay."""
    own = saved(rasters.load(spark, d).join(_folded(spark, d).select(F.col("vec_id").alias("image_id"), "fold"), "image_id"))
    size = (F.col("px"), F.col("h"), F.col("w"))
    names = {"original": F.col("px"), "baseline-normalize": tx.normalize(*size), "auto-gamma": tx.auto_gamma(*size)}
    parts = []
    for name, px in names.items():
        rows = own.select("image_id", "label", "fold", px.cast("array<float>").alias("features"))
        found = settled(spark, lambda rows=rows: learn.knn_across(rows, "image_id", "label"))
        parts.append(found.select(F.lit(name).alias("pipeline_id"), F.col("test_fold").alias("fold"), "actual", "predicted"))
    named = reduce(DataFrame.unionByName, parts)
    classes = own.select(F.col("label").alias("class_index")).distinct()
    entries = metrics.over_folds(metrics.macro(metrics.confusion(named, classes, ["pipeline_id", "fold"]), ["pipeline_id", "fold"]), ["pipeline_id"])
    return metrics.leaderboard(entries.withColumns({"classifier": F.lit("knn"), "feature_profile": F.lit("combined"), "total_ms": F.lit(0.0)}))


@query(_LB + f" SELECT rank, pipeline_id, classifier, 'combined' AS feature_profile, {_STATS_SQL} FROM lb")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d).select(F.col("rank").cast("long").alias("rank"), "pipeline_id", "classifier", "feature_profile", *[_r(c).alias(c) for c in _STATS])


@query(_LB + " SELECT rank, pipeline_id, classifier FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY rank) AS own FROM lb) WHERE own = 1 ORDER BY rank LIMIT 3")
def top_pipelines(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_pipelines(_board(spark, d)).select(F.col("rank").cast("long").alias("rank"), "pipeline_id", "classifier")


@query(_CM + " SELECT pipeline_id, actual, predicted, CAST(sum(n) AS BIGINT) AS n FROM cm GROUP BY ALL")
def aggregate_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).groupBy("pipeline_id", "actual", "predicted").agg(F.sum("n").alias("n"))


@query(_PC + " SELECT pipeline_id, class_index, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM pc GROUP BY ALL")
def class_means(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.per_class(_matrix(spark, d), ["pipeline_id", "fold"])
    return rows.groupBy("pipeline_id", "class_index").agg(*[_r(F.avg(c)).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


# Features


@query(GRID + ", b AS (SELECT image_id, g // 8 AS bin, count(*) AS n FROM px GROUP BY ALL), k AS (SELECT image_id, bin FROM (SELECT DISTINCT image_id FROM px) CROSS JOIN (SELECT unnest(range(32)) AS bin)) SELECT image_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY bin) AS histogram FROM k LEFT JOIN b USING (image_id, bin) GROUP BY image_id")
def color_histogram(spark: SparkSession, d: str) -> DataFrame:
    shares = features.normalized(features.histogram(F.col("px"), 32, 256))
    return rasters.load(spark, d).select("image_id", F.array_join(F.transform(shares, lambda x: F.round(x * 64).cast("int").cast("string")), ",").alias("histogram"))


def _coloured_images(spark: SparkSession, d: str) -> DataFrame:
    """Coloured rasters as images of the image source's struct."""
    hexes = F.flatten(F.transform(F.arrays_zip("b", "g", "r"), lambda s: F.array(*[F.lpad(F.hex(c), 2, "0") for c in (s.b, s.g, s.r)])))
    image = F.struct(F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.unhex(F.array_join(hexes, "")).alias("data"))
    return rasters.coloured(rasters.load(spark, d)).select("image_id", image.alias("image"))


_HUE = "CASE greatest(b, gr, r) - least(b, gr, r) WHEN 0 THEN 0 ELSE CAST(round_even(((CASE WHEN r = greatest(b, gr, r) THEN (gr - b) / s WHEN gr = greatest(b, gr, r) THEN 2 + (b - r) / s ELSE 4 + (r - gr) / s END * 60 + 360) % 360) / 2, 0) AS INT) % 180 END"
_LIGHT = "CAST(greatest(0, least(255, round_even(2.55::DOUBLE * (116 * CASE WHEN ly > 0.008856 THEN cbrt(ly) ELSE 7.787 * ly + 16 / 116.0::DOUBLE END - 16), 0))) AS INT)"
_LINEAR = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"


@query(GRID + _BGR + _SAT + f""", w AS (SELECT *, CAST(greatest(1, greatest(b, gr, r) - least(b, gr, r)) AS DOUBLE) AS s, 0.212671::DOUBLE * {_LINEAR("r")} + 0.715160::DOUBLE * {_LINEAR("gr")} + 0.072169::DOUBLE * {_LINEAR("b")} AS ly, g AS sat FROM s),
v AS (SELECT image_id, 0 AS part, CAST(floor(({_HUE}) * 32 / 180.0::DOUBLE) AS INT) AS bin FROM w UNION ALL SELECT image_id, 1, sat // 8 FROM w UNION ALL SELECT image_id, 2, {_LIGHT} // 8 FROM w),
n AS (SELECT image_id, part * 32 + bin AS i, count(*) AS n FROM v GROUP BY ALL), k AS (SELECT image_id, i FROM (SELECT DISTINCT image_id FROM px) CROSS JOIN (SELECT CAST(unnest(range(96)) AS INT) AS i))
SELECT image_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY i) AS histogram FROM k LEFT JOIN n USING (image_id, i) GROUP BY image_id""")
def colour_features(spark: SparkSession, d: str) -> DataFrame:
    """The 96 shares of hue, saturation and lightness, as counts of the 64 samples."""
    counts = lambda img: [{"histogram": ",".join(str(round(float(x) * 192)) for x in features.color_histogram(img))}]
    return kernels.map_images(_coloured_images(spark, d), ["image_id"], counts, "histogram string")


@query(GRID + _BGR + """, s AS (SELECT image_id, y, x, CAST(round_even(b * 0.114::DOUBLE + gr * 0.587::DOUBLE + r * 0.299::DOUBLE, 0) AS INT) AS g FROM c),
z AS (SELECT CAST(unnest(range(16)) AS INT) AS i), sc AS (SELECT i, greatest(0, least(7, (i + 0.5::DOUBLE) / 2 - 0.5)) AS p FROM z), ax AS (SELECT i, CAST(floor(p) AS INT) AS lo, CAST(least(7, floor(p) + 1) AS INT) AS hi, p - floor(p) AS f FROM sc),
im AS (SELECT image_id, list(CAST(g AS DOUBLE) ORDER BY y, x) AS l FROM s GROUP BY image_id),
big AS (SELECT image_id, u.i AS y, v.i AS x, (l[u.lo * 8 + v.lo + 1] * (1 - v.f) + l[u.lo * 8 + v.hi + 1] * v.f) * (1 - u.f) + (l[u.hi * 8 + v.lo + 1] * (1 - v.f) + l[u.hi * 8 + v.hi + 1] * v.f) * u.f AS g FROM im CROSS JOIN ax u CROSS JOIN ax v),
bl AS (SELECT image_id, list(g ORDER BY y, x) AS l FROM big GROUP BY image_id),
gr AS (SELECT image_id, y.i AS y, x.i AS x, l[y.i * 16 + 15 - abs(15 - (x.i + 1)) + 1] - l[y.i * 16 + abs(x.i - 1) + 1] AS dx, l[(15 - abs(15 - (y.i + 1))) * 16 + x.i + 1] - l[abs(y.i - 1) * 16 + x.i + 1] AS dy FROM bl CROSS JOIN z y CROSS JOIN z x),
vo AS (SELECT image_id, CASE WHEN y < 8 AND x < 8 THEN 0 WHEN x < 8 THEN 1 WHEN y < 8 THEN 2 ELSE 3 END AS cell, sqrt(dx * dx + dy * dy) AS mag, ((degrees(atan2(dy, dx)) + 360) % 180) / 20 - 0.5 AS t FROM gr),
sh AS (SELECT image_id, cell, (CAST(floor(t) AS INT) + 9) % 9 AS bin, mag * (1 - (t - floor(t))) AS v FROM vo UNION ALL SELECT image_id, cell, (CAST(floor(t) AS INT) + 10) % 9, mag * (t - floor(t)) FROM vo),
k AS (SELECT image_id, i, coalesce(v, 0) AS v FROM (SELECT DISTINCT image_id FROM px) CROSS JOIN (SELECT CAST(unnest(range(36)) AS INT) AS i) LEFT JOIN (SELECT image_id, cell * 9 + bin AS i, sum(v) AS v FROM sh GROUP BY ALL) USING (image_id, i)),
o AS (SELECT image_id, i, least(0.2, v / sqrt(sum(v * v) OVER (PARTITION BY image_id) + 1e-6)) AS v FROM k)
SELECT image_id, CAST(i AS INT) AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY image_id) + 1e-6), 6) AS share FROM o""")
def gradient_features(spark: SparkSession, d: str) -> DataFrame:
    """Gradient histograms of coloured rasters at 16 x 16 samples: one block of 2 x 2 cells."""
    one = lambda img: [{"place": i, "share": float(v)} for i, v in enumerate(features.hog_values(img, 16))]
    return kernels.map_images(_coloured_images(spark, d), ["image_id"], one, "place int, share double").withColumn("share", _r("share"))


@query(GRID + """, d8 AS (SELECT image_id, y, list(g ORDER BY x) AS f FROM px GROUP BY ALL), v AS (SELECT y AS word_id, f AS centre FROM d8 WHERE image_id = 0),
n AS (SELECT d8.image_id, d8.y, word_id, row_number() OVER (PARTITION BY d8.image_id, d8.y ORDER BY list_sum(list_transform(list_zip(f, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), word_id) AS r FROM d8 CROSS JOIN v),
c AS (SELECT image_id, word_id, count(*) AS n FROM n WHERE r = 1 GROUP BY ALL), k AS (SELECT image_id, word_id FROM (SELECT DISTINCT image_id FROM px) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS word_id))
SELECT image_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY word_id) AS histogram FROM k LEFT JOIN c USING (image_id, word_id) GROUP BY image_id""")
def bovw_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Rows of samples as descriptors, the rows of image 0 as words."""
    rows = rasters.load(spark, d).select("image_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("px", y * 8 + 1, F.lit(8)))).alias("y", "features"))
    words = rows.where("image_id = 0").select(F.col("y").alias("word_id"), F.col("features").alias("centre"))
    out = features.word_histograms(features.nearest_words(rows, words), "image_id", 8)
    return out.select("image_id", F.array_join(F.transform("histogram", lambda x: F.round(x * 8).cast("int").cast("string")), ",").alias("histogram"))


@query("WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS place FROM u) SELECT vec_id, CAST(pos AS INT) AS pos, place FROM r WHERE place <= 25")
def top_descriptors(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return features.top_descriptors(rows, "vec_id", "v", "pos", 25).select("vec_id", "pos", F.col("place").cast("long").alias("place"))


@query("SELECT t.rank AS top_rank, l.rank, l.pipeline_id, l.classifier FROM (" + _LB + " SELECT * FROM lb) l JOIN (" + _LB + " SELECT rank, pipeline_id, classifier FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY rank) AS own FROM lb) WHERE own = 1 ORDER BY rank LIMIT 3) t ON l.pipeline_id = t.pipeline_id AND l.classifier = t.classifier")
def leaderboard_positions(spark: SparkSession, d: str) -> DataFrame:
    board = _board(spark, d)
    rows = metrics.positions(board, metrics.top_pipelines(board))
    return rows.select(F.col("top_rank").cast("long").alias("top_rank"), F.col("rank").cast("long").alias("rank"), "pipeline_id", "classifier")


@query("WITH u AS (SELECT label, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings) SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95 FROM u GROUP BY label")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _table(spark, d, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.abs(F.col("v").cast("double")))
    means = v.groupBy("label").agg(_r(F.avg("v")).alias("mean"), _r(F.stddev_pop("v")).alias("std"))
    by_share = quantiles.percentiles(v, ["label"], "v", (0.75, 0.95)).groupBy("label").pivot("share", [0.75, 0.95]).agg(F.first("percentile"))
    return means.join(by_share, "label").select("label", "mean", "std", _r("`0.75`").alias("p75"), _r("`0.95`").alias("p95"))


# Texts

def _re2(pattern: str) -> str:
    """A scan's pattern for SQL, where nothing can look behind or ahead: a sign or an end of the text stands in its place."""
    pattern = pattern.replace(r"(?<![\w.\\])", r"(^|[^\w.\\])").replace(r"(?![\w.-])", r"($|[^\w.-])").replace("(?<![A-Za-z0-9_])", "(^|[^A-Za-z0-9_])")
    return pattern.replace(r"\x22", '"').replace("'", "''")


_SCAN_SQL = "SELECT DISTINCT doc_id, description FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k.replace(chr(39), chr(39) * 2)}' AS description FROM documents WHERE regexp_matches(text, '{_re2(v)}')" for k, v in text_checks.SCANS + text_checks.MORE_SCANS) + ")"


@query(_SCAN_SQL)
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.findings(_table(spark, d, "documents"), "doc_id")


@query("WITH f AS (" + _SCAN_SQL + ") SELECT * FROM f WHERE NOT (description = 'e-mail address' AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0'))")
def exempt_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    exempt = docs.where("source = 'src0'").select("doc_id", F.lit("e-mail address").alias("description"))
    return text_checks.findings(docs, "doc_id", exempt=exempt)


_LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS link_no FROM pages)"""


@query(_LINKS + " SELECT page_id, link_no, target FROM l")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.html_links(_table(spark, d, "pages"), "page_id").select("page_id", F.col("link_no").cast("long").alias("link_no"), "target")


@query(_LINKS + " SELECT DISTINCT target FROM l WHERE target NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) FROM pages)")
def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    wanted = text_checks.html_links(pages, "page_id").select("target").distinct()
    return text_checks.missing(wanted, pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1).alias("target")), ["target"])


_HEAD = r"""WITH h AS (SELECT page_id, lower(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))) AS heading, regexp_extract(url, '/([a-z]{2})/', 1) AS lang FROM pages),
s AS (SELECT *, replace(regexp_replace(heading, '[^a-z0-9_\- ]', '', 'g'), ' ', '-') AS slug FROM h)"""


@query(_HEAD + " SELECT page_id, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY lang, slug ORDER BY page_id) - 1 AS n FROM s)")
def heading_slugs(spark: SparkSession, d: str) -> DataFrame:
    heads = _table(spark, d, "pages").select("page_id", F.regexp_replace(F.lower(F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))), r"[^a-z0-9_\- ]", "").alias("heading"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    rows = heads.withColumn("slug", F.regexp_replace("heading", " ", "-"))
    rows = split.places(rows, ["lang", "slug"], ["page_id"], "place")
    n = F.col("place") - 1
    return rows.select("page_id", F.when(n == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("anchor"))


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"


@query(_LINES + " SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '(?i)(licen[cs]e|copyright)') AND NOT regexp_matches(line, '(?i)permission')")
def claim_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = text_checks.lines(_table(spark, d, "documents"), "doc_id")
    return text_checks.claims(rows, "line", "(?i)(licen[cs]e|copyright)", "(?i)permission").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(_LINES + r""" SELECT doc_id, line_no, CAST(len(c) AS INT) AS cells, c[1] AS first_cell FROM (SELECT doc_id, line_no, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS c FROM l WHERE contains(line, '|'))""")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = text_checks.table_cells(text_checks.lines(_table(spark, d, "documents"), "doc_id"), "line")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("cells").alias("cells"), F.get("cells", F.lit(0)).alias("first_cell"))


@query("SELECT page_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS figure FROM pages WHERE regexp_matches(url, '/[0-9]+')")
def metric_extract(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").where(F.col("url").rlike("/[0-9]+")).select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("figure"))


@query("WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, e.n AS expected, a.n AS actual FROM e FULL JOIN a USING (lang) WHERE e.n IS DISTINCT FROM a.n")
def evidence_mismatch(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    by_lang = lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return text_checks.mismatched(by_lang(_table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id")), by_lang(docs), ["lang"], "n")


@query("SELECT doc_id, sha256(text) AS checksum, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def sha256_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT CASE WHEN lower(source) LIKE '.%' THEN NULL ELSE source END AS class_name, CAST(dense_rank() OVER (ORDER BY lower(source), source) - 1 AS INT) AS class_index, n, n >= 5 AS enough FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def class_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Sources as classes: index in case-insensitive order, and whether each has five samples."""
    n = _table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("source").alias("class_name"), (F.dense_rank().over(W.orderBy(F.lower("source"), "source")) - 1).alias("class_index"), "n", (F.col("n") >= 5).alias("enough"))


# Kernels and learners without a form in SQL


def _as_images(spark: SparkSession, d: str, scale: int = 4, folds: DataFrame | None = None) -> DataFrame:
    """Rasters as colour images of the image source's struct, each sample repeated `scale` times both ways; with their folds, if these are given."""
    side = rasters.SIDE * scale

    def grown(planes: pd.Series) -> pd.Series:
        return planes.map(lambda px: np.kron(np.asarray(px, np.uint8).reshape(rasters.SIDE, -1), np.ones((scale, scale), np.uint8))[..., None].repeat(3, axis=2).tobytes())

    grown.__annotations__ = {"planes": pd.Series, "return": pd.Series}
    rows = rasters.load(spark, d) if folds is None else rasters.load(spark, d).join(folds, "image_id")
    return rasters.dealt(rows, "image_id").select("image_id", "label", *([] if folds is None else ["fold"]), F.struct(F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.pandas_udf(grown, "binary")("px").alias("data")).alias("image"))


def _kernel(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        import hashlib

        f = kernels.EXPLORER[name]

        def one(img) -> list[dict]:
            out = f(img, 5)
            return [{"mean": round(float(out.mean()), 6), "sha256": hashlib.sha256(out.tobytes()).hexdigest()}]

        return kernels.map_images(_as_images(spark, d), ["image_id"], one, "mean double, sha256 string")

    run.__name__ = "explore_" + name.lower().replace(" ", "_")
    return run


for _name in ("CLAHE", "Bilateral Filter", "Canny", "Contours", "Connected Components"):
    query()(_kernel(_name))


@query()
def image_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return kernels.map_images(_as_images(spark, d), ["image_id"], lambda img: [{k: float(v) for k, v in kernels.diagnose(img).items()}], ", ".join(f"{m} double" for m in dx.METRICS))


@query()
def advise_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: every pipeline of the catalogue that suits the profile on every image, all metrics, the three best."""
    best = advisor.recommend(advisor.measured(_as_images(spark, d).withColumnRenamed("image_id", "path"), "auto"), "auto")
    return best.select(F.col("path").alias("image_id"), "rank", "pipeline_id", _r("score").alias("score"), F.array_join("warnings", ",").alias("warnings"), F.array_join("reasons", "; ").alias("reasons"))


@query()
def bovw_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Shares of fitted words: the k-means of all descriptors of all images."""
    rows = rasters.load(spark, d).select("image_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("px", y * 8 + 1, F.lit(8)))).alias("features"))
    words = features.fit_vocabulary(rows, 16)
    return features.word_histograms(features.nearest_words(rows, words), "image_id", 16, rasters.load(spark, d).select("image_id"))


@query(GRID + _BGR + _SAT + """, gy AS (SELECT image_id, y, x, CAST(round_even(b * 0.114::DOUBLE + gr * 0.587::DOUBLE + r * 0.299::DOUBLE, 0) AS INT) AS v, abs(r - gr) AS rg, abs(0.5::DOUBLE * (r + gr) - b) AS yb, g AS sat FROM s),
p AS (SELECT image_id, v, count(*) / 64.0 AS p FROM gy GROUP BY ALL), en AS (SELECT image_id, -sum(p * log2(p)) AS bits FROM p GROUP BY image_id)
SELECT image_id, round(avg(v), 6) AS mean_brightness, round(avg(CASE WHEN v <= 5 THEN 1.0 ELSE 0 END), 6) AS dark_clip_ratio, round(avg(CASE WHEN v >= 250 THEN 1.0 ELSE 0 END), 6) AS bright_clip_ratio, round(stddev_pop(v), 6) AS global_contrast, round(any_value(bits), 6) AS entropy,
round(sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)), 6) AS colorfulness, round(stddev_pop(sat), 6) AS saturation_spread FROM gy JOIN en USING (image_id) GROUP BY image_id""")
def kernel_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the kernels on coloured rasters, against SQL on the samples."""
    names = ("mean_brightness", "dark_clip_ratio", "bright_clip_ratio", "global_contrast", "entropy", "colorfulness", "saturation_spread")
    found = kernels.map_images(_coloured_images(spark, d), ["image_id"], lambda img: [{m: float(kernels.diagnose(img)[m]) for m in names}], ", ".join(f"{m} double" for m in names))
    return found.select("image_id", *[(_r(m) + 0.0).alias(m) for m in names])


@query()
def image_features(spark: SparkSession, d: str) -> DataFrame:
    return features.extract(_as_images(spark, d), ["image_id", "label"], "texture")


@query()
def scale_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Scale-invariant keypoints of the enlarged rasters."""
    return features.scale_descriptors(_as_images(spark, d), ["image_id"])


@query()
def scale_words(spark: SparkSession, d: str) -> DataFrame:
    """Shares of words in every raster, by words of the training folds' descriptors alone."""
    images = saved(_folded(spark, d).select(F.col("vec_id").alias("image_id"), "fold"))
    found = features.scale_descriptors(_as_images(spark, d, folds=images), ["image_id", "fold"])
    return features.fold_words(saved(found.select("image_id", "fold", "features")), "image_id", images, 16)


@query()
def svm_cv(spark: SparkSession, d: str) -> DataFrame:
    z = learn.standardize(_folded(spark, d), features="embedding")
    return learn.svm_cv(z, "vec_id", "label")


@query()
def svm_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every fold predicted by exact machines of the other folds."""
    z = learn.standardize(_folded(spark, d), features="embedding")
    return cascade.svm_cv(z, "vec_id", "label")


@query()
def random_forest_cv(spark: SparkSession, d: str) -> DataFrame:
    z = learn.standardize(_folded(spark, d), features="embedding")
    return learn.random_trees_cv(z, "vec_id", "label")


@query()
def kmeans_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return features.fit_vocabulary(_table(spark, d, "embeddings").withColumnRenamed("embedding", "features"), 8)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
