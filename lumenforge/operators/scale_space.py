"""Scale-invariant descriptors in NumPy: extrema of a pyramid of differences of Gaussians, refined between samples, turned by
their own gradients, told by 128 shares of gradients (D. Lowe, Distinctive Image Features from Scale-Invariant Keypoints, 2004).

`describe` takes one image, `describe_stack` several of one size; `features.scale_descriptors` runs it over Arrow batches of images.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    """The figures of the paper: blur of an octave's first plane, planes for each doubling, contrast below which a point goes,
    ratio of curvatures above which it counts as an edge."""

    sigma: float = 1.6
    intervals: int = 3
    contrast: float = 0.04
    edge: float = 10.0
    assumed_blur: float = 0.5
    margin: int = 5
    smallest: int = 12


@dataclass(frozen=True)
class Point:
    """A keypoint: image of its stack, octave, place in its plane (layer, y, x, with fractions) and the size of its extremum."""

    image: int
    octave: int
    layer: float
    y: float
    x: float
    response: float


def _part(g: np.ndarray, axis: int, start: int, stop: int | None) -> np.ndarray:
    return g[(slice(None),) * axis + (slice(start, stop),)]


def blur(g: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(4 * sigma))
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (g.ndim - 2, g.ndim - 1):
        n = g.shape[axis]
        p = np.pad(g, [(r, r) if a == axis else (0, 0) for a in range(g.ndim)], "symmetric")
        g = taps[r] * _part(p, axis, r, r + n)
        for i in range(r):  # the taps are the same on both sides
            g += taps[i] * (_part(p, axis, i, i + n) + _part(p, axis, 2 * r - i, 2 * r - i + n))
    return g


def doubled(g: np.ndarray) -> np.ndarray:
    """Twice the size: samples stay, new ones lie half-way between."""
    for axis in (g.ndim - 2, g.ndim - 1):
        after = np.concatenate([_part(g, axis, 1, None), _part(g, axis, -1, None)], axis)
        g = np.stack([g, (g + after) / 2], axis + 1).reshape([2 * n if a == axis else n for a, n in enumerate(g.shape)])
    return g


def pyramid(g: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Octaves of intervals + 3 ever more blurred planes, on the last axis but two; the first octave has twice the image's size."""
    steps = s.sigma * 2 ** (np.arange(s.intervals + 3) / s.intervals)
    base = blur(doubled(g), np.sqrt(max(s.sigma**2 - (2 * s.assumed_blur) ** 2, 0.01)))
    out = []
    while min(base.shape[-2:]) >= s.smallest:
        planes = [base]
        for before, after in zip(steps, steps[1:], strict=False):
            planes.append(blur(planes[-1], np.sqrt(after**2 - before**2)))
        out.append(np.stack(planes, axis=-3))
        base = planes[s.intervals][..., ::2, ::2]
    return out


def _around(d: np.ndarray, pick) -> np.ndarray:
    """The extreme of each 3 x 3 x 3 neighbourhood, without the rim."""
    for axis in range(d.ndim - 3, d.ndim):
        d = pick(pick(_part(d, axis, 0, -2), _part(d, axis, 1, -1)), _part(d, axis, 2, None))
    return d


def _slopes(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second differences over (layer, y, x) at points (image, layer, y, x)."""
    unit = np.eye(4, dtype=int)[1:]
    v = lambda *steps: d[tuple((at + sum(steps, np.zeros(4, int))).T)]
    first = np.stack([(v(u) - v(-u)) / 2 for u in unit], 1)
    second = np.empty((len(at), 3, 3))
    for i, a in enumerate(unit):
        second[:, i, i] = v(a) + v(-a) - 2 * v()
        for j in range(i):
            b = unit[j]
            second[:, i, j] = second[:, j, i] = (v(a, b) - v(a, -b) - v(-a, b) + v(-a, -b)) / 4
    return first, second


def extrema(planes: np.ndarray, octave: int, s: Settings) -> list[Point]:
    """Extrema over place and scale of the images of a stack, moved to the top of the parabola through their neighbours; weak ones and
    edges go."""
    d = np.diff(planes, axis=1)
    least, m = s.contrast / s.intervals, s.margin
    if min(d.shape[2:]) <= 2 * m + 1:
        return []
    inner = d[:, 1:-1, 1:-1, 1:-1]
    found = (np.abs(inner) > 0.8 * least) & (((inner > 0) & (inner == _around(d, np.maximum))) | ((inner < 0) & (inner == _around(d, np.minimum))))
    at = np.argwhere(found) + np.array([0, 1, 1, 1])
    low, high = np.array([0, 1, m, m]), np.array(d.shape) - np.array([1, 2, m + 1, m + 1])
    at = at[((at >= low) & (at <= high)).all(1)]
    out: dict[tuple, Point] = {}
    for _ in range(5):
        if not len(at):
            break
        first, second = _slopes(d, at)
        sound = np.abs(np.linalg.det(second)) > 1e-18
        at, first, second = at[sound], first[sound], second[sound]
        off = -np.linalg.solve(second, first[..., None])[..., 0]
        done = (np.abs(off) <= 0.5).all(1)
        value = d[tuple(at.T)] + 0.5 * (first * off).sum(1)
        trace, det = second[:, 1, 1] + second[:, 2, 2], second[:, 1, 1] * second[:, 2, 2] - second[:, 1, 2] ** 2
        kept = done & (np.abs(value) >= least) & (det > 0) & (trace**2 * s.edge < (s.edge + 1) ** 2 * det)
        for p, o, v in zip(at[kept].tolist(), off[kept].tolist(), value[kept].tolist(), strict=True):
            out.setdefault(tuple(p), Point(p[0], octave, p[1] + o[0], p[2] + o[1], p[3] + o[2], abs(v)))
        at = at[~done]
        at[:, 1:] += np.clip(np.rint(off[~done]), -5, 5).astype(int)
        at = at[((at >= low) & (at <= high)).all(1)]
    return list(out.values())


def gradients(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and angles of a plane's central differences; the rim has none."""
    dy, dx = np.zeros_like(plane), np.zeros_like(plane)
    dy[1:-1, 1:-1], dx[1:-1, 1:-1] = plane[2:, 1:-1] - plane[:-2, 1:-1], plane[1:-1, 2:] - plane[1:-1, :-2]
    return np.hypot(dy, dx), np.arctan2(dy, dx)


Gradients = tuple[np.ndarray, np.ndarray]


def _patch(own: Gradients, y: float, x: float, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets from the point (down as a column, across as a row), sizes and angles of the samples around it."""
    h, w = own[0].shape
    y0, y1, x0, x1 = max(1, round(y) - r), min(h - 1, round(y) + r + 1), max(1, round(x) - r), min(w - 1, round(x) + r + 1)
    return (np.arange(y0, y1) - y)[:, None], (np.arange(x0, x1) - x)[None, :], own[0][y0:y1, x0:x1], own[1][y0:y1, x0:x1]


def turns(own: Gradients, y: float, x: float, sigma: float, bins: int = 36) -> list[float]:
    """Angles of the peaks, at least 0.8 of the highest, of the histogram of gradients around a point."""
    oy, ox, size, angle = _patch(own, y, x, round(4.5 * sigma))
    weight = size * np.exp(-(oy**2 + ox**2) / (2 * (1.5 * sigma) ** 2))
    hist = np.bincount(np.rint(angle / (2 * np.pi) * bins).astype(int).ravel() % bins, weight.ravel(), bins)
    for _ in range(2):
        ring = np.concatenate([hist[-1:], hist, hist[:1]])
        hist = (ring[:-2] + 2 * hist + ring[2:]) / 4
    ring = np.concatenate([hist[-1:], hist, hist[:1]])
    left, right = ring[:-2], ring[2:]
    out = []
    for i in np.flatnonzero((hist > left) & (hist >= right) & (hist >= 0.8 * hist.max())):
        bend = left[i] - 2 * hist[i] + right[i]
        out.append((i + (0.5 * (left[i] - right[i]) / bend if bend else 0.0)) / bins * 2 * np.pi % (2 * np.pi))
    return out


def shares(own: Gradients, y: float, x: float, sigma: float, angle: float, cells: int = 4, bins: int = 8) -> np.ndarray:
    """Gradients around a point in its own turn, shared among the nearest of 4 x 4 cells and 8 directions; of length 1, cut at
    0.2, of length 1 again."""
    width = 3 * sigma
    oy, ox, size, turn = _patch(own, y, x, round(width * np.sqrt(2) * (cells + 1) / 2))
    c, s = np.cos(angle), np.sin(angle)
    across, down = (ox * c + oy * s) / width, (oy * c - ox * s) / width
    inside = (down + cells / 2 - 0.5 > -1) & (down + cells / 2 - 0.5 < cells) & (across + cells / 2 - 0.5 > -1) & (across + cells / 2 - 0.5 < cells)
    across, down = across[inside], down[inside]
    weight = size[inside] * np.exp(-(across**2 + down**2) / (cells**2 / 2))
    place = [down + cells / 2 - 0.5, across + cells / 2 - 0.5, (turn[inside] - angle) / (2 * np.pi) * bins % bins]
    low = [np.floor(p).astype(int) for p in place]
    both = [((q + 1, 1 - (p - q)), (q + 2, p - q)) for p, q in zip(place, low, strict=True)]  # the two nearest, with their shares
    rows, cols = [(a * ((cells + 2) * bins), u) for a, u in both[0]], [(b * bins, v) for b, v in both[1]]
    turned = [(np.where(e > bins, e - bins - 1, e - 1), t) for e, t in both[2]]
    at, part = np.empty((8, len(weight)), np.int64), np.empty((8, len(weight)))
    i = 0
    for a, u in rows:
        for b, v in cols:
            ab, uv = a + b, u * v
            for e, t in turned:
                np.add(ab, e, out=at[i])
                np.multiply(uv, t, out=part[i])
                i += 1
    part *= weight
    out = np.bincount(at.ravel(), part.ravel(), (cells + 2) ** 2 * bins)
    v = out.reshape(cells + 2, cells + 2, bins)[1:-1, 1:-1].ravel()
    v = np.minimum(v / max(np.linalg.norm(v), 1e-12), 0.2)
    return v / max(np.linalg.norm(v), 1e-12)


def describe(grey: np.ndarray, most: int = 250, settings: Settings | None = None) -> list[dict]:
    """The `most` strongest descriptors of a grey image (0 to 255), by response, then place and angle: y, x, scale (blur in
    samples), angle (from the x axis, towards y), response and 128 features. Flat or tiny images have none."""
    return describe_stack(np.asarray(grey)[None], most, settings)[0]


def describe_stack(stack: np.ndarray, most: int = 250, settings: Settings | None = None) -> list[list[dict]]:
    """`describe` of the images of one size in a stack (n, h, w): pyramids and extrema of all of them are made together."""
    s = settings or Settings()
    octaves = pyramid(stack.astype(np.float64) / 255, s)
    points: list[list[Point]] = [[] for _ in stack]
    for o, planes in enumerate(octaves):
        for p in extrema(planes, o, s):
            points[p.image].append(p)
    return [_told(own, i, octaves, most, s) for i, own in enumerate(points)]


def _told(points: list[Point], image: int, octaves: list[np.ndarray], most: int, s: Settings) -> list[dict]:
    """The descriptors of an image's points."""
    out, seen = [], {}
    for p in sorted(points, key=lambda p: (-round(p.response, 9), p.octave, p.y, p.x))[:most]:
        layer = min(max(round(p.layer), 0), s.intervals + 2)
        if (own := seen.get((p.octave, layer))) is None:
            own = seen[p.octave, layer] = gradients(octaves[p.octave][image, layer])
        sigma, grown = s.sigma * 2 ** (p.layer / s.intervals), 2.0 ** (p.octave - 1)
        for angle in turns(own, p.y, p.x, sigma):
            features = shares(own, p.y, p.x, sigma, angle).tolist()
            out.append({"y": float(p.y * grown), "x": float(p.x * grown), "scale": float(sigma * grown), "angle": float(angle), "response": p.response, "features": features})
    return out[:most]
