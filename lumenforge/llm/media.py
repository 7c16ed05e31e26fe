"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with
difference hashes. Any bytes can be stored as a grey image and read back without loss.

Defined results: null bytes or text count as empty; a payload is padded with zero bytes to a positive multiple of WIDTH,
so an empty text is one row of zeros; bytes that are no image of a known kind raise ValueError in `decode` and give null
columns in `media_columns`; rows with the same id stay rows of their own; further columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

WIDTH = 64
#: Samples of the largest image that is decoded.
MOST_SAMPLES = 1 << 30


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Grey 8-bit samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 or BMP (8-bit grey or palette, 24 or 32 bits, uncompressed) as uint8 (h, w) or RGB (h, w, 3)."""
    try:
        if data[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError("damaged image") from e
    raise ValueError("neither Netpbm nor BMP")


def _check_size(w: int, h: int, depth: int = 1) -> None:
    if w < 1 or h < 1 or w * h * depth > MOST_SAMPLES:
        raise ValueError(f"an image of {w} x {h}")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("header cut short")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], (head[2] if len(head) > 2 else 1)
    depth = 3 if kind in (3, 6) else 1
    _check_size(w, h, depth)
    if not 0 < top < 65536:
        raise ValueError(f"samples up to {top}")
    n = w * h * depth
    if kind == 1:  # digits may stand without blanks between them
        samples = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[:n] - 48
    elif kind < 4:
        samples = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        samples = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(samples) < n:
        raise ValueError("samples cut short")
    if samples.size and not 0 <= samples.min() <= samples.max() <= top:
        raise ValueError("samples out of range")
    if kind in (1, 4):
        samples = (1 - samples) * 255  # 1 is black
    elif top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    out = samples.astype(np.uint8, copy=False)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    _check_size(w, abs(h), bits // 8)
    step, rows = (w * bits // 8 + 3) // 4 * 4, abs(h)
    px = np.frombuffer(data, np.uint8, step * rows, start).reshape(rows, step)[:, : w * bits // 8]
    if h > 0:
        px = px[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256:
            raise ValueError(f"a palette of {used}")
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)
        rgb = palette[px][..., 2::-1]
        return rgb[..., 0].copy() if (rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 1] == rgb[..., 2]).all() else rgb.copy()
    return px.reshape(rows, w, bits // 8)[..., 2::-1].copy()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else ((pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from the integral image read at fractional places: exact at any ratio."""
    h, w = pixels.shape
    rows = np.zeros((h + 1, w), np.float64)
    np.cumsum(pixels, axis=0, out=rows[1:])
    ys = np.linspace(0, h, height + 1)
    y0 = np.minimum(ys.astype(np.int64), h - 1)
    bands = np.diff(rows[y0] + (ys - y0)[:, None] * pixels[y0], axis=0)  # one row for each target row
    cols = np.zeros((height, w + 1), np.float64)
    np.cumsum(bands, axis=1, out=cols[:, 1:])
    xs = np.linspace(0, w, width + 1)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    sums = np.diff(cols[:, x0] + (xs - x0) * bands[:, x0], axis=1)
    return np.floor(np.round(sums / ((h / height) * (w / width)), 6) + 0.5).clip(0, 255).astype(np.uint8)  # halves go up, whatever the last bits


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, as hex: whether each of 9 x 8 area means is less than its right neighbour."""
    small = area_resize(grey(pixels), 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, area_resize(grey(pixels), side, side))
    return out.getvalue()


def text_to_pgm(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text as a PGM of WIDTH samples a row, and how many they are."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    pad = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
    return encode_pgm(np.frombuffer(pad, np.uint8).reshape(-1, WIDTH)), len(raw)


def media_columns(media: DataFrame, id_col: str, data_col: str, tile_side: int = 16) -> DataFrame:
    """Images in a binary column decoded: id, height, width, channels, dhash, npy_tile (binary NPY)."""
    arrow_rows(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for data in b.column(1).to_pylist():
                try:
                    px = decode(data or b"")
                    got.append((*px.shape[:2], 1 if px.ndim == 2 else 3, difference_hash(px), npy_tile(px, tile_side)))
                except ValueError:
                    got.append((None,) * 5)
            cols = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True))], names=[id_col, "height", "width", "channels", "dhash", "npy_tile"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, data_col).mapInArrow(run, f"`{id_col}` {kind}, height int, width int, channels int, dhash string, npy_tile binary")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an image and the stored bytes decoded again: id, n_bytes, media (binary PGM), payload (its samples),
    dhash, npy_tile (binary NPY). Written as a table, that is the tiles with their hashes."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text in b.column(1).to_pylist():
                stored, n = text_to_pgm(text)
                px = decode(stored)
                got.append((n, stored, px.tobytes(), difference_hash(px), npy_tile(px)))
            cols = list(zip(*got, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[id_col, "n_bytes", "media", "payload", "dhash", "npy_tile"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary, payload binary, dhash string, npy_tile binary")
