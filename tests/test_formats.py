"""Decoders against files of the Java image library and hand-made ones; the drop folder's batches."""

import struct
import zlib

import numpy as np
import pytest

from lumenforge.sources import formats, images
from lumenforge.streaming import drop_folder


def scene(h: int = 45, w: int = 70) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    return np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (3 * x + 2 * y) % 256 / 2 + 60], axis=2).astype(np.uint8)


def by_java(spark, img: np.ndarray, path, kind: str, grey: bool = False) -> bytes:
    """The image as a file of Java's image library."""
    jvm = spark._jvm
    h, w = img.shape[:2]
    out = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            b, g, r = (int(v) for v in img[y, x])
            out.setRGB(x, y, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(out, kind, jvm.java.io.File(str(path)))
    return path.read_bytes()


@pytest.mark.parametrize(("kind", "size"), [("jpg", (45, 70)), ("jpg", (8, 8)), ("jpg", (1, 1)), ("jpg", (33, 16)), ("png", (45, 70)), ("bmp", (20, 33)), ("tiff", (20, 33))])
def test_decoders_agree_with_the_image_source(spark, tmp_path, kind, size):
    data = by_java(spark, scene(*size), tmp_path / f"a.{kind}", kind)
    got = images.decode_image(data).astype(int)
    r = spark.read.format("image").load(str(tmp_path)).first().image
    want = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels).astype(int)
    assert got.shape == want.shape
    assert np.abs(got - want).max() <= (3 if kind == "jpg" else 0) and np.abs(got - want).mean() <= 0.5


def test_grey_jpeg(spark, tmp_path):
    data = by_java(spark, scene()[..., :1].repeat(3, axis=2), tmp_path / "a.jpg", "jpg", grey=True)
    r = spark.read.format("image").load(str(tmp_path)).first().image
    want = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, -1)[..., 0].astype(int)
    got = images.decode_image(data)
    assert (got[..., 0] == got[..., 2]).all() and np.abs(got[..., 0].astype(int) - want).max() <= 1


def test_damaged_files_are_refused(spark, tmp_path):
    whole = [by_java(spark, scene(20, 20), tmp_path / f"a.{k}", k) for k in ("jpg", "png", "bmp", "tiff")]
    rng = np.random.default_rng(1)
    for data in [*whole, b"P5\n4 4\n255\n" + bytes(16)]:
        for cut in (3, 20, len(data) // 2):
            with pytest.raises(ValueError):
                images.decode_image(data[:cut])
        for _ in range(60):
            bad = bytearray(data)
            for at in rng.integers(2, len(bad), 3):
                bad[at] = int(rng.integers(0, 256))
            try:
                images.decode_image(bytes(bad))
            except ValueError:
                pass
    rows = spark.createDataFrame([(1, bytearray(whole[0])), (2, bytearray(b"no")), (3, None), (4, bytearray(whole[0][:100]))], "k int, content binary")
    assert {r.k: r.image is not None for r in images.decode_bytes(rows, "k", "content").collect()} == {1: True, 2: False, 3: False, 4: False}


def png_of(px: np.ndarray, depth: int, kind: int, laced: bool, palette: bytes = b"") -> bytes:
    """Samples (h, w, channels) of any depth as a PNG without filters."""
    h, w, channels = px.shape
    raw = b""
    for y, x, down, across in formats.PASSES if laced else ((0, 0, 1, 1),):
        part = px[y::down, x::across]
        if not part.size:
            continue
        for row in part.reshape(len(part), -1):
            bits = "".join(f"{int(v):0{depth}b}" for v in row)
            raw += b"\0" + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("depth", "kind"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (8, 4), (8, 6), (16, 6), (1, 3), (2, 3), (4, 3), (8, 3)])
def test_png_depths_and_interlacing(depth, kind, laced):
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    for h, w in ((11, 13), (1, 1), (3, 2), (8, 8)):
        px = np.random.default_rng(h).integers(0, 1 << depth, (h, w, channels))
        palette = np.random.default_rng(1).integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        got = formats.decode(png_of(px, depth, kind, laced, palette.tobytes() if kind == 3 else b""))
        eight = px >> 8 if depth == 16 else px * 255 // ((1 << depth) - 1)
        want = palette[px[..., 0]][..., ::-1] if kind == 3 else eight[..., :1].repeat(3, axis=2) if channels < 3 else eight[..., 2::-1]
        assert np.array_equal(got, want), (h, w)


def test_netpbm_and_tiff_by_hand():
    assert formats.decode(b"P6\n# note\n2 1\n# more\n255\n" + bytes([1, 2, 3, 4, 5, 6])).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert formats.decode(b"P5 1 2 15\n" + bytes([15, 5]))[..., 0].tolist() == [[255], [85]]
    for e, order in (("<", b"II*\0"), (">", b"MM\0*")):
        for packed, code in ((bytes([9, 7, 7, 7]), 1), (zlib.compress(bytes([9, 7, 7, 7])), 8), (bytes([0, 9, 254, 7]), 32773)):
            tags = [(256, 2), (257, 2), (258, 8), (259, code), (262, 1), (273, 8), (277, 1), (279, len(packed))]
            at = 8 + len(packed) + len(packed) % 2
            body = struct.pack(e + "H", len(tags)) + b"".join(struct.pack(e + "HHII", t, 4, 1, v) for t, v in tags)
            assert formats.decode(order + struct.pack(e + "I", at) + packed.ljust(at - 8, b"\0") + body)[..., 1].tolist() == [[9, 7], [7, 7]]


def test_a_failed_batch_leaves_each_row_once(spark, tmp_path):
    there = tmp_path / "in"
    there.mkdir()
    img = scene(24, 30)
    (there / "a.png").write_bytes(images.encode_png(img))
    (there / "b.ppm").write_bytes(b"P6\n30 24\n255\n" + img[..., ::-1].tobytes())
    by_java(spark, img, there / "c.bmp", "bmp")
    (there / "d.png").write_bytes(b"no image")
    where = [str(tmp_path / x) for x in ("out", "state", "ranks")]
    fail = lambda batch: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(Exception, match="lost"):
        drop_folder.run_once(spark, str(there), *where, after=fail)
    drop_folder.run_once(spark, str(there), *where)
    (there / "e.jpg").write_bytes(by_java(spark, img, tmp_path / "e.jpg", "jpg"))
    drop_folder.run_once(spark, str(there), *where)
    rows = spark.read.parquet(where[0]).collect()
    assert sorted(r.path.rpartition("/")[2] for r in rows) == ["a.png", "b.ppm", "c.bmp", "e.jpg"]
    assert len({round(r.mean_brightness, 6) for r in rows if not r.path.endswith("jpg")}) == 1
    ranks = spark.read.parquet(where[2]).collect()
    assert sorted((r.path.rpartition("/")[2], r["rank"]) for r in ranks) == [(f, i) for f in ("a.png", "b.ppm", "c.bmp", "e.jpg") for i in (1, 2, 3)]
