"""Small images for demonstrations and self-checks, drawn in NumPy on the driver."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from ..operators.kernels import gaussian
from .images import encode_png


def _grey(g: np.ndarray) -> np.ndarray:
    return np.clip(g, 0, 255).astype(np.uint8)[..., None].repeat(3, axis=2)


def ramp(side: int = 128, low: int = 105, high: int = 135) -> np.ndarray:
    """A low-contrast gradient."""
    return _grey(np.tile(np.linspace(low, high, side), (side, 1)))


def demo(h: int = 320, w: int = 480) -> np.ndarray:
    """A dark field with a block, a disc and a bright stroke."""
    y, x = np.mgrid[:h, :w]
    out = np.full((h, w, 3), 75, np.uint8)
    out[(y > h * 0.17) & (y < h * 0.83) & (x > w * 0.08) & (x < w * 0.44)] = (180, 120, 50)
    out[(y - h * 0.5) ** 2 + (x - w * 0.71) ** 2 < (h * 0.28) ** 2] = (60, 165, 210)
    out[abs((y - h * 0.94) + (x - w * 0.04) * (h * 0.86) / (w * 0.9)) < 3] = 240
    return out


def tile(side: int = 512, seed: int = 42) -> np.ndarray:
    """A low-contrast tile: a gradient with waves, seeded noise, a frame, a scratch and a dark spot, smoothed."""
    y, x = np.mgrid[:side, :side].astype(np.float64)
    g = 112 + 10 * x / side + 6 * np.sin(y / 42) + 3 * np.sin(x / 7.5) * np.cos(y / 11)
    g += np.random.default_rng(seed).normal(0, 2.2, g.shape)
    edge = np.maximum(abs(x - side / 2) / 0.36, abs(y - side / 2) / 0.29) - side
    g[abs(edge) < 4] = 121
    g[(abs(y - side * 0.62 + (x - side / 2) * 0.1) < 2) & (abs(x - side / 2) < side * 0.28)] = 96
    g[(y - side * 0.37) ** 2 + (x - side * 0.68) ** 2 < (side * 0.043) ** 2] = 99
    return gaussian(_grey(g), 5)


def shapes(root: str | Path, each: int = 6, side: int = 96) -> Path:
    """Two class folders, of discs and of squares that grow from file to file."""
    y, x = np.mgrid[:side, :side] - side // 2
    for name, size in (("circle", lambda n: np.hypot(y, x) <= n), ("square", lambda n: np.maximum(abs(y), abs(x)) <= n)):
        folder = Path(root) / name
        folder.mkdir(parents=True, exist_ok=True)
        for i in range(each):
            (folder / f"{i:02}.png").write_bytes(encode_png(_grey(np.where(size(side // 5 + i), 225, 35 + i))))
    return Path(root)
