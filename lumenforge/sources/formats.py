"""Image files as arrays of blue, green and red samples: JPEG (baseline), PNG, BMP, TIFF and binary Netpbm, by their public
specifications. Anything damaged or of another kind raises ValueError."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

MOST_SAMPLES = 1 << 28


def _sized(w: int, h: int, channels: int = 1) -> None:
    if not (w > 0 and h > 0 and w * h * channels <= MOST_SAMPLES):
        raise ValueError("an image of no size, or too large")


def _bgr(px: np.ndarray) -> np.ndarray:
    """From (h, w, channels): grey and grey with alpha are repeated, red, green and blue turned round, alpha left out."""
    return px[..., :1].repeat(3, axis=2) if px.shape[2] < 3 else np.ascontiguousarray(px[..., 2::-1])


# PNG

#: First row and column, and steps down and across, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def png(data: bytes) -> np.ndarray:
    """Depths of 1 to 16 bits (of 16 the upper 8), interlaced or not."""
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    allowed = {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(kind, (8, 16))
    if channels is None or depth not in allowed or laced > 1:
        raise ValueError("a PNG of an unknown kind")
    _sized(w, h, channels)
    at, packed, palette = 8, [], b""
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        packed += [body] if name == b"IDAT" else []
        palette = body if name == b"PLTE" else palette
        at += n + 12
    raw, px, start = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), np.zeros((h, w, channels), np.uint8), 0
    for y, x, down, across in PASSES if laced else ((0, 0, 1, 1),):
        rows, cols = -(-(h - y) // down), -(-(w - x) // across)
        if rows <= 0 or cols <= 0:
            continue
        width = -(-cols * channels * depth // 8)
        lines = raw[start : start + rows * (width + 1)].reshape(rows, width + 1)
        start += rows * (width + 1)
        px[y::down, x::across] = _samples(_unfiltered(lines, max(1, channels * depth // 8)), depth, cols * channels, kind == 3).reshape(rows, cols, channels)
    return np.frombuffer(palette, np.uint8).reshape(-1, 3)[px[..., 0]][..., ::-1].copy() if kind == 3 else _bgr(px)


def _samples(lines: np.ndarray, depth: int, count: int, numbers: bool) -> np.ndarray:
    """Samples of 8 bits, or numbers of a palette, from the bytes of rows."""
    if depth == 16:
        return lines[:, ::2]
    if depth == 8:
        return lines
    shifts = np.arange(8 - depth, -1, -depth)
    values = ((lines[..., None] >> shifts) & ((1 << depth) - 1)).reshape(len(lines), -1)[:, :count]
    return (values if numbers else values * (255 // ((1 << depth) - 1))).astype(np.uint8)


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows that begin with their filter and tell differences from bytes `step` before and above."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + step), np.int64)  # a row and a sample of nothing before the first
    for y, line in enumerate(lines.astype(np.int64)):
        kind, line, above, own = int(line[0]), line[1:], out[y], out[y + 1]
        if kind in (0, 2):
            own[step:] = (line + (above[step:] if kind else 0)) & 255
        elif kind == 1:
            own[step:] = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
        elif kind in (3, 4):
            for i in range(step, len(own)):
                a, b, c = int(own[i - step]), int(above[i]), int(above[i - step])
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                own[i] = (int(line[i - step]) + guess) & 255
        else:
            raise ValueError("an unknown PNG filter")
    return out[1:, step:].astype(np.uint8)


# BMP, Netpbm


def bmp(data: bytes) -> np.ndarray:
    start, (w, h) = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26])
    bits, packed = struct.unpack("<HI", data[28:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("a BMP of this kind is not supported")
    _sized(w, abs(h), 4)
    width = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data[start : start + width * abs(h)], np.uint8)
    if len(rows) < width * abs(h):
        raise ValueError("the BMP is cut short")
    px = rows.reshape(abs(h), width)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., :3]
    return px[::-1].copy() if h > 0 else px.copy()


def netpbm(data: bytes) -> np.ndarray:
    """Binary grey (P5) and colour (P6) of up to 8 bits; comments in the head are passed over."""
    at, numbers = 2, []
    while len(numbers) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    w, h, top = numbers
    channels = 3 if data[:2] == b"P6" else 1
    _sized(w, h, channels)
    body = np.frombuffer(data[at + 1 : at + 1 + w * h * channels], np.uint8)
    if not 0 < top < 256 or len(body) < w * h * channels:
        raise ValueError("a Netpbm file that is cut short, or of more than 8 bits")
    px = body.reshape(h, w, channels)
    return _bgr(px if top == 255 else np.minimum(px.astype(np.int64) * 255 // top, 255).astype(np.uint8))


# TIFF

#: The tags that are read.
WIDTH, LENGTH, BITS, COMPRESSION, MEANING, STRIPS, SAMPLES, STRIP_BYTES, PLANES, PREDICTOR, COLOURS = 256, 257, 258, 259, 262, 273, 277, 279, 284, 317, 320


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def tiff(data: bytes) -> np.ndarray:
    """The first image of a file in strips of 8-bit samples: plain, deflated or in packed bits; grey, palette or colour."""
    e = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(e + "I", data[4:8])[0]
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
        if code and n <= 1 << 20:
            where = at + 10 + 12 * i if n * size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = struct.unpack(f"{e}{n}{code}", data[where : where + n * size])
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, channels, meaning = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(MEANING)
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(one(COMPRESSION, 1))
    if unpack is None or not w or not h or set(tags.get(BITS, (8,))) != {8} or meaning not in (0, 1, 2, 3) or (channels > 1 and one(PLANES, 1) != 1) or (meaning == 2) != (channels >= 3):
        raise ValueError("a TIFF of this kind is not supported")
    _sized(w, h, channels)
    raw = b"".join(unpack(data[a : a + n]) for a, n in zip(tags[STRIPS], tags[STRIP_BYTES], strict=True))
    px = np.frombuffer(raw[: w * h * channels], np.uint8).reshape(h, w, channels)
    if one(PREDICTOR, 1) == 2:
        px = np.cumsum(px, axis=1, dtype=np.uint8)
    if meaning == 3:
        return (np.array(tags[COLOURS]).reshape(3, 256) >> 8).astype(np.uint8).T[px[..., 0]][..., ::-1].copy()
    return _bgr(255 - px if meaning == 0 else px)


# JPEG

#: Places of the 64 coefficients of a block in the order of their diagonals, which run up and down in turn.
DIAGONAL = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """A scan's bits between two restarts; past their end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.last = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0, 8 * len(data) + 64

    def peek(self) -> int:
        """The next 16 bits."""
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        """A number of n bits, the lower half of which stand for negative ones."""
        v = self.peek() >> (16 - n) if n else 0
        self.at += n
        if self.at > self.last:
            raise ValueError("the JPEG is cut short")
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits, symbol) for each of the 65,536 values that the next 16 bits may have."""
    table, code, k = [(0, 0)] * (1 << 16), 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[k : k + n]:
            low = code << (16 - bits)
            table[low : low + (1 << (16 - bits))] = [(bits, s)] * (1 << (16 - bits))
            code += 1
        k += n
        code <<= 1
    return table[: 1 << 16]


class _Part:
    """A colour component: sampling, tables, and its blocks in rows."""

    def __init__(self, key: int, sampling: int, table: int):
        self.key, self.h, self.v, self.table = key, sampling >> 4, sampling & 15, table
        if not (1 <= self.h <= 4 and 1 <= self.v <= 4):
            raise ValueError("a JPEG of unknown sampling")


def _block(bits: _Bits, out: np.ndarray, before: int, dc: list, ac: list) -> int:
    n, size = dc[bits.peek()]
    if not n or size > 15:
        raise ValueError("a damaged JPEG")
    bits.at += n
    before += bits.take(size)
    out[0] = before
    k = 1
    while k < 64:
        n, symbol = ac[bits.peek()]
        if not n:
            raise ValueError("a damaged JPEG")
        bits.at += n
        run, size = symbol >> 4, symbol & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a damaged JPEG")
        out[k] = bits.take(size)
        k += 1
    return before


def _between(near: np.ndarray, axis: int) -> np.ndarray:
    """Sums of three times each sample and the one before, and the one after it, in turn."""
    before = np.concatenate([np.take(near, [0], axis), np.take(near, range(near.shape[axis] - 1), axis)], axis)
    after = np.concatenate([np.take(near, range(1, near.shape[axis]), axis), np.take(near, [-1], axis)], axis)
    return np.stack([3 * near + before, 3 * near + after], axis + 1)


def _enlarged(p: np.ndarray, across: int, down: int) -> np.ndarray:
    """A component at the size of the image: doubled ones by triangles, others by repeating."""
    h, w = p.shape
    x = p.astype(np.int64)
    if (across, down) == (2, 1) and w > 2:
        return ((_between(x, 1) + np.array([1, 2])) >> 2).reshape(h, 2 * w)
    if (across, down) == (2, 2) and w > 2:
        rows = _between(x, 0).reshape(2 * h, w)
        return ((_between(rows, 1) + np.array([8, 7])) >> 4).reshape(2 * h, 2 * w)
    return x.repeat(down, axis=0).repeat(across, axis=1)


def _segments(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, body, coded data after it)."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a damaged JPEG")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        start = at
        while marker == 0xDA:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                at = len(data)
                break
            if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                break
            at += 2
        yield marker, body, data[start:at]


def jpeg(data: bytes) -> np.ndarray:
    """Sequential JPEG of 8 bits by Huffman codes, of one component or three."""
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    parts: list[_Part] = []
    w = h = every = 0
    plain = scanned = False
    for marker, body, coded in _segments(data):
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3):
                raise ValueError("a JPEG of this kind is not supported")
            _sized(w, h, n)
            parts = [_Part(*body[6 + 3 * i : 9 + 3 * i]) for i in range(n)]
            if n == 1:
                parts[0].h = parts[0].v = 1
            top_h, top_v = max(p.h for p in parts), max(p.v for p in parts)
            for p in parts:
                if top_h % p.h or top_v % p.v:
                    raise ValueError("a JPEG of unknown sampling")
                p.rows, p.cols = -(-h // (8 * top_v)) * p.v, -(-w // (8 * top_h)) * p.h
                p.own_rows, p.own_cols = -(-(-(-h * p.v // top_v)) // 8), -(-(-(-w * p.h // top_h)) // 8)
                p.blocks = np.zeros((p.rows, p.cols, 64), np.int64)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("a JPEG of this kind is not supported")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            plain = body[11] == 0
        elif marker == 0xDA:
            named = {p.key: p for p in parts}
            chosen = [(named[body[1 + 2 * i]], codes[body[2 + 2 * i] >> 4], codes[16 | body[2 + 2 * i] & 15]) for i in range(body[0])]
            _scan(chosen, coded, every)
            scanned = True
    if not scanned:
        raise ValueError("a JPEG without an image")
    planes = []
    for p in parts:
        block = np.zeros((p.rows, p.cols, 64))
        block[..., DIAGONAL] = p.blocks * quant[p.table]
        x = np.einsum("ux,rcuv,vy->rcxy", _COSINES, block.reshape(p.rows, p.cols, 8, 8), _COSINES)
        plane = np.clip(np.rint(x) + 128, 0, 255).transpose(0, 2, 1, 3).reshape(8 * p.rows, 8 * p.cols)
        own = plane[: -(-h * p.v // max(q.v for q in parts)), : -(-w * p.h // max(q.h for q in parts))]
        planes.append(_enlarged(own, max(q.h for q in parts) // p.h, max(q.v for q in parts) // p.v)[:h, :w])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[..., None].repeat(3, axis=2)
    if plain:
        return np.stack(planes[::-1], axis=2).astype(np.uint8)
    y, cb, cr = planes[0].astype(float), planes[1] - 128.0, planes[2] - 128.0
    rgb = np.stack([y + 1.772 * cb, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.402 * cr], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _scan(chosen: list[tuple[_Part, list, list]], coded: bytes, every: int) -> None:
    """Fills the blocks of a scan's components: of several in turn within units, of one alone row by row without padding."""
    pieces, at = [], 0
    while (cut := coded.find(b"\xff", at)) >= 0:  # restarts part the data
        if coded[cut + 1 : cut + 2] and 0xD0 <= coded[cut + 1] <= 0xD7:
            pieces.append(coded[:cut])
            coded, at = coded[cut + 2 :], 0
        else:
            at = cut + 2
    pieces.append(coded)
    if len(chosen) == 1:
        p, *tables = chosen[0]
        units = [[(0, p.blocks[y, x], *tables)] for y in range(p.own_rows) for x in range(p.own_cols)]
    else:
        first = chosen[0][0]
        units = [
            [(i, p.blocks[y * p.v + b, x * p.h + a], dc, ac) for i, (p, dc, ac) in enumerate(chosen) for b in range(p.v) for a in range(p.h)]
            for y in range(first.rows // first.v) for x in range(first.cols // first.h)
        ]
    size = every or len(units)
    if len(pieces) < -(-len(units) // size):
        raise ValueError("the JPEG is cut short")
    for start, piece in zip(range(0, len(units), size), pieces, strict=False):
        bits, before = _Bits(piece), [0] * len(chosen)
        for unit in units[start : start + size]:
            for i, out, dc, ac in unit:
                before[i] = _block(bits, out, before[i], dc, ac)


#: Decoders by the first bytes of a file.
FORMATS: tuple[tuple[bytes, Callable[[bytes], np.ndarray]], ...] = (
    (b"\x89PNG\r\n\x1a\n", png), (b"\xff\xd8", jpeg), (b"BM", bmp), (b"II*\0", tiff), (b"MM\0*", tiff), (b"P5", netpbm), (b"P6", netpbm),
)


def decode(data: bytes) -> np.ndarray:
    for head, f in FORMATS:
        if data.startswith(head):
            try:
                return f(data)
            except (struct.error, zlib.error, IndexError, KeyError, OverflowError, MemoryError, TypeError) as e:
                raise ValueError("not a readable image") from e
    raise ValueError("not an image of a known format")
