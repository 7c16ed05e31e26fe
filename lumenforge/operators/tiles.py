"""Images larger than a row, as tables of tiles.

A tile is a row: the image's keys, its place in the grid of tiles (ty, tx), in the image (top, left), its and the image's size,
and its samples, channel by channel in row order. Filters that look at neighbours get a halo: each tile sends strips of its rim
to the tiles around it, so only rims travel between images' parts; a chain of such filters sends one halo as wide as their
reaches together. Since borders of the array are the image's own borders or lie beyond the halo, the result is that of the
whole image, sample by sample. What needs the whole image (its range, mean, histograms, components) is added up from tiles.

Keys tell images apart, may not be null and have none of the names used here. Every tile but the last of a row or column has the same size, at least that of the
halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from . import graph, kernels, transforms

PLACE = ("ty", "tx", "top", "left", "rows", "cols", "height", "width")
_PLACE = ", ".join(f"{c} int" for c in PLACE)

Frames = Iterator[pd.DataFrame]


def _samples(t) -> np.ndarray:
    return np.frombuffer(t.data, np.uint8).reshape(t.rows, t.cols, -1)


def _schema(tiles: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys) + ", " + rest


def _each(tiles: DataFrame, keys: list[str], f: Callable[..., list[dict]], schema: str) -> DataFrame:
    """f of each tile gives rows, which get the tile's keys."""

    def run(batches: Frames) -> Frames:
        for b in batches:
            rows = [{k: getattr(t, k) for k in keys} | r for t in b.itertuples(index=False) for r in f(t)]
            if rows:
                yield pd.DataFrame(rows)

    return tiles.mapInPandas(run, _schema(tiles, keys, schema))


def _place(t) -> dict:
    return {c: getattr(t, c) for c in PLACE}


def cut(images: DataFrame, keys: list[str], side: int = 512) -> DataFrame:
    """Tiles of images that are one row each."""
    if side < 1:
        raise ValueError("side must be positive")

    def one(img) -> list[dict]:
        h, w = img.shape[:2]
        parts = ((y, x, img[y : y + side, x : x + side]) for y in range(0, h, side) for x in range(0, w, side))
        return [{"ty": y // side, "tx": x // side, "top": y, "left": x, "rows": p.shape[0], "cols": p.shape[1], "height": h, "width": w, "data": p.tobytes()} for y, x, p in parts]

    return kernels.map_images(images, keys, one, f"{_PLACE}, data binary")


def _send(t, halo: int) -> list[dict]:
    """Strips of a tile's rim for the tiles around it."""
    data, out = _samples(t), []
    last_y, last_x = t.top + t.rows == t.height, t.left + t.cols == t.width
    if (halo > t.rows and not last_y) or (halo > t.cols and not last_x):
        raise ValueError("tiles must be as wide as the halo")
    part = {-1: slice(0, halo), 0: slice(None), 1: slice(-halo, None)}
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy, dx) == (0, 0) or (dy < 0 and not t.ty) or (dy > 0 and last_y) or (dx < 0 and not t.tx) or (dx > 0 and last_x):
                continue
            own = data[part[dy], part[dx]]
            top = t.top + (max(t.rows - halo, 0) if dy > 0 else 0)
            left = t.left + (max(t.cols - halo, 0) if dx > 0 else 0)
            out.append({"ty": t.ty + dy, "tx": t.tx + dx, "s_top": top, "s_left": left, "s_rows": own.shape[0], "s_cols": own.shape[1], "s_data": own.tobytes()})
    return out


def local(tiles: DataFrame, keys: list[str], halo: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`f` of every tile with its halo, cut back to the tile. f keeps height and width and reaches `halo` samples at most."""
    schema = _schema(tiles, keys, f"{_PLACE}, data binary")

    def done(t, whole: np.ndarray, y: int, x: int) -> dict:
        return _place(t) | {"data": np.ascontiguousarray(f(whole)[y : y + t.rows, x : x + t.cols]).tobytes()}

    if not halo:
        return _each(tiles.select(*keys, *PLACE, "data"), keys, lambda t: [done(t, _samples(t), 0, 0)], f"{_PLACE}, data binary")

    def meet(own: pd.DataFrame, strips: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in own.itertuples(index=False):
            y0, x0 = max(0, t.top - halo), max(0, t.left - halo)
            y1, x1 = min(t.height, t.top + t.rows + halo), min(t.width, t.left + t.cols + halo)
            data = _samples(t)
            whole = np.zeros((y1 - y0, x1 - x0, data.shape[2]), np.uint8)
            whole[t.top - y0 : t.top - y0 + t.rows, t.left - x0 : t.left - x0 + t.cols] = data
            for s in strips.itertuples(index=False):
                whole[s.s_top - y0 : s.s_top - y0 + s.s_rows, s.s_left - x0 : s.s_left - x0 + s.s_cols] = np.frombuffer(s.s_data, np.uint8).reshape(s.s_rows, s.s_cols, -1)
            out.append({k: getattr(t, k) for k in keys} | done(t, whole, t.top - y0, t.left - x0))
        return pd.DataFrame(out, columns=[*keys, *PLACE, "data"])

    strips = _each(tiles, keys, lambda t: _send(t, halo), "ty int, tx int, s_top int, s_left int, s_rows int, s_cols int, s_data binary")
    by = [*keys, "ty", "tx"]
    return tiles.select(*keys, *PLACE, "data").groupBy(*by).cogroup(strips.groupBy(*by)).applyInPandas(meet, schema)


# Transforms of the catalogue

#: How far the transforms look that see neighbours alone, by their parameters.
REACH: dict[str, Callable[[dict], int]] = {
    "gaussian": lambda p: p.get("kernel_size", 5) // 2, "median": lambda p: p.get("kernel_size", 5) // 2, "unsharp": lambda p: p.get("kernel_size", 5) // 2,
    "bilateral": lambda p: max(1, p.get("diameter", 7) // 2), "blackhat": lambda p: 2 * (p.get("kernel_size", 9) // 2), "gray_bgr": lambda p: 0,
}


def _with(tiles: DataFrame, keys: list[str], figures: DataFrame, f: Callable[..., np.ndarray]) -> DataFrame:
    """f(tile, samples) of tiles joined with figures of their image."""
    names = [c for c in figures.columns if c not in keys]
    both = tiles.select(*keys, *PLACE, "data").join(figures, keys)
    out = _each(both, keys, lambda t: [_place(t) | {"data": f(t, _samples(t)).tobytes()}], f"{_PLACE}, data binary")
    assert names
    return out


def _normalize(tiles: DataFrame, keys: list[str]) -> DataFrame:
    ends = _each(tiles, keys, lambda t: [{"low": int(_samples(t).min()), "high": int(_samples(t).max())}], "low int, high int")

    def stretch(t, x: np.ndarray) -> np.ndarray:
        return kernels.normalize(np.append(x.ravel(), [t.low, t.high]).astype(np.uint8))[:-2]

    return _with(tiles, keys, ends.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high")), stretch)


def _auto_gamma(tiles: DataFrame, keys: list[str], target_midpoint: float = 0.5) -> DataFrame:
    sums = _each(tiles, keys, lambda t: [{"level_sum": int(kernels.grey(_samples(t)).sum(dtype=np.int64))}], "level_sum long")
    return _with(tiles, keys, sums.groupBy(*keys).agg(F.sum("level_sum").alias("level_sum")), lambda t, x: kernels.gamma_table(t.level_sum / (t.height * t.width) / 255, target_midpoint)[x])


def _lab_clahe(tiles: DataFrame, keys: list[str], clip_limit: float = 2.0, grid_size: int = 8) -> DataFrame:
    """Counts of levels by cell are added up, 256 figures for each of grid_size x grid_size cells of an image."""
    if clip_limit <= 0 or grid_size <= 0:
        raise ValueError("clip_limit and grid_size must be positive")

    def counted(t) -> list[dict]:
        counts = kernels.Grid(t.height, t.width, grid_size).counts(kernels.lightness(_samples(t)), t.top, t.left)
        cell, level = np.nonzero(counts)
        return [{"at": cell * 256 + level, "n": counts[cell, level]}]

    some = _each(tiles, keys, counted, "at array<int>, n array<long>").select(*keys, F.inline(F.arrays_zip("at", "n")))
    counts = some.groupBy(*keys, "at").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def blended(t, x: np.ndarray) -> np.ndarray:
        grid, full = kernels.Grid(t.height, t.width, grid_size), np.zeros(grid_size**2 * 256, np.int64)
        full[np.asarray(t.at)] = t.n
        return kernels.with_lightness(x, grid.blend(kernels.lightness(x), grid.tables(full.reshape(-1, 256), clip_limit), t.top, t.left))

    return _with(tiles, keys, counts, blended)


#: Transforms that need figures of the whole image.
WHOLE: dict[str, Callable[..., DataFrame]] = {"normalize": _normalize, "auto_gamma": _auto_gamma, "lab_clahe": _lab_clahe}


def transformed(tiles: DataFrame, keys: list[str], steps) -> DataFrame:
    """The tiles of images after the steps (transform, params) of a pipeline. Neighbouring filters run together under one halo;
    before a step that needs the whole image, what was done so far is written."""
    chain: list[tuple[Callable[..., np.ndarray], dict, int]] = []

    def flushed(rows: DataFrame) -> DataFrame:
        fs, reach = [(f, p) for f, p, _ in chain], sum(r for *_, r in chain)
        chain.clear()

        def run(x: np.ndarray) -> np.ndarray:
            for f, p in fs:
                x = f(x, **p)
            return x

        return local(rows, keys, reach, run) if fs else rows

    for s in steps:
        transforms.check_config(s.transform, s.params)
        if s.transform in WHOLE:
            tiles = WHOLE[s.transform](saved(flushed(tiles)), keys, **s.params)
        elif s.transform in REACH:
            chain.append((kernels.REGISTRY[s.transform], s.params, REACH[s.transform](s.params)))
        else:
            raise ValueError(f"the reach of {s.transform} is not known: add it to REACH, or to WHOLE")
    return flushed(tiles)


# Components and edges


def _rims(t) -> list[dict]:
    """Labels along the sides that a tile shares with others, under the place of the pair: the tile above or on the left of it."""
    x, out = np.frombuffer(t.labels, np.int64).reshape(t.rows, t.cols), []
    last_y, last_x = t.top + t.rows == t.height, t.left + t.cols == t.width
    give = lambda kind, ty, tx, second, v: out.append({"kind": kind, "py": ty, "px": tx, "second": second, "rim": v.tolist()})
    if not last_x:
        give("right", t.ty, t.tx, False, x[:, -1])
    if t.tx:
        give("right", t.ty, t.tx - 1, True, x[:, 0])
    if not last_y:
        give("below", t.ty, t.tx, False, x[-1])
    if t.ty:
        give("below", t.ty - 1, t.tx, True, x[0])
    if not last_y and not last_x:
        give("down", t.ty, t.tx, False, x[-1, -1:])
    if t.ty and t.tx:
        give("down", t.ty - 1, t.tx - 1, True, x[0, :1])
    if not last_y and t.tx:
        give("up", t.ty, t.tx, False, x[-1, :1])
    if t.ty and not last_x:
        give("up", t.ty - 1, t.tx + 1, True, x[0, -1:])
    return out


def _touching(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    x, y = np.asarray(a, np.int64), np.asarray(b, np.int64)
    found = set()
    for d in (-1, 0, 1):
        p, q = x[max(0, -d) : len(x) - max(0, d)], y[max(0, d) : len(y) - max(0, -d)]
        both = (p > 0) & (q > 0)
        found |= set(zip(p[both].tolist(), q[both].tolist(), strict=True))
    return sorted(found)


def components(masks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of tiles with one channel, 0 for the background, 1 for samples and more for marked ones: (labelled tiles, components).

    Samples are connected with all eight around them, over tiles too. The labelled tiles have `labels`, an 8-byte integer for each
    sample: 1 + the place, in row order of the image, of the first sample of its part within the tile, 0 for the background. The
    components are (keys, component, part, samples, marked): for each such part the least part it is connected with, its
    samples and whether any is marked."""

    def label(t) -> list[dict]:
        x = _samples(t)[..., 0]
        own = kernels.components(x > 0)
        flat = own.ravel()
        first = np.zeros(own.max() + 1, np.int64)
        at = np.flatnonzero(flat)[::-1]
        first[flat[at]] = (t.top + at // t.cols).astype(np.int64) * t.width + t.left + at % t.cols + 1
        return [_place(t) | {"labels": first[own].tobytes(), "marks": x.tobytes()}]

    labelled = saved(_each(masks, keys, label, f"{_PLACE}, labels binary, marks binary"))

    def sizes(t) -> list[dict]:
        part, at, n = np.unique(np.frombuffer(t.labels, np.int64), return_inverse=True, return_counts=True)
        marked = np.zeros(len(part), bool)
        marked[at.ravel()[np.frombuffer(t.marks, np.uint8) > 1]] = True
        return [{"part": int(p), "samples": int(c), "marked": bool(m)} for p, c, m in zip(part, n, marked, strict=True) if p]

    parts = saved(_each(labelled, keys, sizes, "part long, samples long, marked boolean"))
    rims = _each(labelled, keys, _rims, "kind string, py int, px int, second boolean, rim array<long>")
    by = [*keys, "kind", "py", "px"]
    facing = rims.where("not second").drop("second").join(rims.where("second").select(*by, F.col("rim").alias("other")), by)

    def pairs(rows: Frames) -> Frames:
        for b in rows:
            out = [{k: getattr(r, k) for k in keys} | {"a": x, "b": y} for r in b.itertuples(index=False) for x, y in _touching(r.rim, r.other)]
            if out:
                yield pd.DataFrame(out)

    edges = facing.mapInPandas(pairs, _schema(rims, keys, "a long, b long"))
    node = lambda c: F.struct(*keys, F.col(c).alias("part"))
    roots = graph.components(edges.select(node("a").alias("a"), node("b").alias("b"))).select("node.*", F.col("root.part").alias("component"))
    return labelled, parts.join(roots, [*keys, "part"], "left").select(*keys, F.coalesce("component", "part").alias("component"), "part", "samples", "marked")


def component_sizes(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, samples, marked) of whole images' components; `component` is 1 + the place of the first sample of one of
    its parts."""
    _, parts = components(masks, keys)
    return parts.groupBy(*keys, "component").agg(F.sum("samples").alias("samples"), F.max("marked").alias("marked"))


def edge_metrics(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edge_density, edge_continuity) of whole images: Canny's weak ridges in tiles with a halo, their components over
    tiles, of which those with a strong sample are edges; thresholds follow the image's median level."""
    levels = _each(tiles, keys, lambda t: [{"level": i, "n": int(n), "height": t.height, "width": t.width} for i, n in enumerate(np.bincount(kernels.grey(_samples(t)).ravel(), minlength=256)) if n], "level int, n long, height int, width int")
    counts = levels.groupBy(*keys, "level").agg(F.sum("n").alias("n"), F.first("height").alias("height"), F.first("width").alias("width"))
    hist = saved(counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("levels"), (F.first("height").cast("long") * F.first("width")).alias("area")))

    def thresholds(rows: Frames) -> Frames:
        for b in rows:
            out = []
            for r in b.itertuples(index=False):
                level, upto = [x["level"] for x in r.levels], np.cumsum([x["n"] for x in r.levels])
                middle = [level[int(np.searchsorted(upto, k, side="right"))] for k in ((r.area - 1) // 2, r.area // 2)]
                low, high = kernels.edge_thresholds(sum(middle) / 2)
                out.append({k: getattr(r, k) for k in keys} | {"low": low, "high": high})
            if out:
                yield pd.DataFrame(out)

    figures = hist.mapInPandas(thresholds, _schema(hist, keys, "low int, high int"))
    # The thresholds travel in two channels beside the grey one, so that the filter's halo has them too.
    grey = _with(tiles, keys, figures, lambda t, x: np.stack([kernels.grey(x), np.full(x.shape[:2], t.low, np.uint8), np.full(x.shape[:2], t.high, np.uint8)], axis=2))

    def ridges(x: np.ndarray) -> np.ndarray:
        weak, strong = kernels.ridges(x[..., 0], int(x[0, 0, 1]), int(x[0, 0, 2]))
        return weak.astype(np.uint8) + 2 * strong.astype(np.uint8)

    sizes = component_sizes(local(grey, keys, 2, ridges), keys).where("marked")
    edges = sizes.groupBy(*keys).agg(F.sum("samples").alias("edges"), F.sum(F.when(F.col("samples") >= 8, F.col("samples")).otherwise(0)).alias("long"))
    both = hist.select(*keys, "area").join(edges, keys, "left")
    return both.select(*keys, F.coalesce(F.col("edges") / F.col("area"), F.lit(0.0)).alias("edge_density"), F.coalesce(F.col("long") / F.col("edges"), F.lit(0.0)).alias("edge_continuity"))
