"""Expressions on planes: an image of h x w samples is one row with an ARRAY<INT> in row order.

Every function here works inside the row, so filters, borders and reductions never shuffle or explode pixels; big images
take the Arrow kernels of `operators.kernels` instead, which give the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Tap = tuple[int, int, float]


def _index(p: Column, n: Column, border: str) -> Column:
    if border == "reflect":  # without repeating the edge sample
        return (n - 1) - F.abs((n - 1) - F.abs(p))
    return F.greatest(F.lit(0), F.least(n - 1, p))


def neighbours(px: Column, h: Column, w: Column, border: str, fold: Callable[[Callable[[int, int], Column]], Column]) -> Column:
    """A plane whose sample is `fold(at)`, where at(dy, dx) is the sample so far below and right of it."""

    def one(i: Column) -> Column:
        y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
        return fold(lambda dy, dx: F.get(px, _index(y + dy, h, border) * w + _index(x + dx, w, border)))

    return F.transform(F.sequence(F.lit(0), F.size(px) - 1), one)


def once(px: Column, f: Callable[[Column], Column]) -> Column:
    """f of a computed plane. Bound as a lambda's variable the plane is made once, not again for each sample that f reads."""
    return F.get(F.transform(F.array(px), f), F.lit(0))


def weighted(px: Column, h: Column, w: Column, taps: Sequence[Tap], border: str = "reflect") -> Column:
    def fold(at):
        out = F.lit(0.0)
        for dy, dx, c in taps:
            out = out + at(dy, dx) * F.lit(float(c))
        return out

    return neighbours(px, h, w, border, fold)


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element of k x k."""
    r = k // 2
    out = []
    for dy in range(-r, r + 1):
        reach = round(r * (1 - dy * dy / (r * r)) ** 0.5) if r else 0
        out += [(dy, dx) for dx in range(-reach, reach + 1)]
    return out


def cross(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, dx) for dy, dx in square(k) if dy == 0 or dx == 0] if r else [(0, 0)]


SHAPES = {"rect": square, "ellipse": ellipse, "cross": cross}


def extreme(px: Column, h: Column, w: Column, offsets: list[tuple[int, int]], largest: bool) -> Column:
    pick = F.greatest if largest else F.least
    return neighbours(px, h, w, "replicate", lambda at: pick(*[at(dy, dx) for dy, dx in offsets]) if len(offsets) > 1 else at(*offsets[0]))


def byte(x: Column) -> Column:
    """Half-even rounding into 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(x, 0).cast("int")))


def total(px: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def mean(px: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return total(px, f) / F.size(px)


def variance(px: Column) -> Column:
    """Population variance."""
    m = mean(px)
    return F.greatest(F.lit(0.0), mean(px, lambda x: x.cast("double") * x.cast("double")) - m * m)


def tiles(px: Column, h: Column, w: Column, side: int) -> Column:
    """The plane's tiles of `side` x `side`, smaller at the right and lower edges, as an array of arrays."""
    across = F.ceil(w / side).cast("int")
    down = F.ceil(h / side).cast("int")

    def tile(t: Column) -> Column:
        y0, x0 = F.floor(t / across).cast("int") * side, (t % across).cast("int") * side
        rows = F.transform(F.sequence(y0, F.least(y0 + side, h) - 1), lambda y: F.slice(px, y * w + x0 + 1, F.least(F.lit(side), w - x0)))
        return F.flatten(rows)

    return F.transform(F.sequence(F.lit(0), across * down - 1), tile)
