"""Image files: class folders as a table, with unreadable files kept apart; PNG bytes; checked ZIP archives."""

from __future__ import annotations

import re
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from pathlib import Path, PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import formats
from .shared import Folder, saved

SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
MOST_FILES, MOST_BYTES = 10_000, 1_000_000_000


@dataclass(frozen=True)
class Manifest:
    """samples: path, class_name, class_index, width, height, checksum, image. skipped: path, reason."""

    class_names: list[str]
    samples: DataFrame
    skipped: DataFrame


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, suffix, content checksum, image) of all files below. Bytes are read once for the checksums, which are written and
    joined to the decoded images by path; so the images stay where they were read if the checksums' size allows."""
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        img = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(root) from e
        raise
    files = saved(raw.select(plain_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("checksum")))
    return img.select(plain_path(F.col("image.origin")).alias("path"), "image").join(files, "path").withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def valid(image: str = "image") -> Column:
    """Whether a row holds a colour image of its stated size."""
    c = lambda f: F.col(f"{image}.{f}")
    return (c("nChannels") == 3) & (c("mode") == 16) & (c("height") > 0) & (c("width") > 0) & (F.length(c("data")) == c("height") * c("width") * 3)


def _three(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Three channels from one or four."""

    def one(raw: bytes, n: int) -> bytes:
        px = np.frombuffer(raw, np.uint8)
        return np.repeat(px, 3).tobytes() if n == 1 else px[: len(px) // 4 * 4].reshape(-1, 4)[:, :3].tobytes()

    return pd.Series([None if raw is None else one(raw, n) for raw, n in zip(data, channels, strict=True)])


def as_colour(df: DataFrame, image: str = "image") -> DataFrame:
    """Grey images replicated to three channels, a fourth channel dropped; the rest as it is."""
    c = lambda f: F.col(f"{image}.{f}")
    _three.__annotations__ = {"data": pd.Series, "channels": pd.Series, "return": pd.Series}
    few = c("mode").isin(0, 24)  # bytes of one or four channels
    data = F.when(few, F.pandas_udf(_three, "binary")(c("data"), c("nChannels"))).otherwise(c("data"))
    fields = (c("origin"), c("height"), c("width"), F.when(few, 3).otherwise(c("nChannels")).alias("nChannels"), F.when(few, 16).otherwise(c("mode")).alias("mode"), data.alias("data"))
    return df.withColumn(image, F.struct(*fields))


def discover(spark: SparkSession, root: str, least: int = 5) -> Manifest:
    """A folder of class folders. Classes are the visible folders, empty ones too, in case-insensitive order; each needs
    `least` images that can be read and are of 8-bit samples. Others are skipped with a reason."""
    files = scan(spark, root)
    top = Folder(spark, root)
    base = re.sub("^file:/+", "/", top.full).rstrip("/") + "/"
    names = sorted((n for n in top.folders() if not n.startswith(".")), key=lambda s: (s.casefold(), s))
    if len(names) < 2:
        raise ValueError("at least two class folders are needed")
    inner = files.where(F.col("path").startswith(base)).withColumn("below", F.substring("path", len(base) + 1, 1 << 20)).withColumn("class_name", F.element_at(F.split("below", "/"), 1))
    inner = saved(as_colour(inner.where(F.col("class_name").isin(*names) & F.col("below").contains("/") & F.col("suffix").isin(*SUFFIXES))).withColumn("valid", F.coalesce(valid(), F.lit(False))))
    by = {r.class_name: r.n for r in inner.groupBy("class_name").agg(F.count(F.when(F.col("valid"), 1)).alias("n")).collect()}
    for name in names:
        if by.get(name, 0) < least:
            raise ValueError(f"class {name} has {by.get(name, 0)} valid images, {least} are needed")
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    samples = inner.where("valid").select("path", "class_name", index[F.col("class_name")].alias("class_index"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), "checksum", "image")
    why = F.when(F.coalesce(F.col("image.height"), F.lit(-1)) <= 0, "unreadable image").otherwise("not an image of 8-bit samples")
    return Manifest(names, samples, inner.where("not valid").select("path", why.alias("reason")))


def in_file_order(samples: DataFrame) -> DataFrame:
    """By path without regard to case, then by path: a sort by ranges, in no single task."""
    return samples.orderBy(F.lower("path"), "path")


def check_bgr(img: object) -> np.ndarray:
    """The contract of a decoded image: blue, green and red samples of 8 bits, not empty."""
    if not isinstance(img, np.ndarray):
        raise TypeError("an image is an array")
    if img.dtype != np.uint8:
        raise ValueError("an image has samples of 8 bits")
    if img.ndim != 3 or img.shape[2] != 3 or not img.size:
        raise ValueError("an image has rows, columns and three channels, and none is empty")
    return img


def decode_image(data: bytes) -> np.ndarray:
    """An uploaded image file as blue, green and red samples; ValueError for anything that `formats` cannot read."""
    return check_bgr(formats.decode(data))


def decode_bytes(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, image as in the image source) of a column of bytes; null where it cannot be decoded."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b[key], b[content], strict=True):
                try:
                    img = decode_image(data or b"")
                    rows.append((k, {"origin": "", "height": img.shape[0], "width": img.shape[1], "nChannels": 3, "mode": 16, "data": img.tobytes()}))
                except ValueError:
                    rows.append((k, None))
            yield pd.DataFrame(rows, columns=[key, "image"])

    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def encode_png(img: np.ndarray) -> bytes:
    """A colour image (blue, green, red) as PNG."""
    h, w = img.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img[..., ::-1].reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def extract_zip(data: bytes, to: str | Path) -> Path:
    """An archive of a dataset, checked before anything is written; a single folder at its top is the result."""
    to = Path(to)
    if to.exists():
        raise FileExistsError(to)
    try:
        z = zipfile.ZipFile(BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a ZIP archive") from e
    with z:
        files = [i for i in z.infolist() if not i.is_dir()]
        if not files or len(files) > MOST_FILES or sum(i.file_size for i in files) > MOST_BYTES:
            raise ValueError("the archive is empty or too large")
        for i in z.infolist():
            if why := _refused(i):
                raise ValueError(f"refused, {why}: {i.filename}")
        z.extractall(to)
    inside = [p for p in to.iterdir() if not p.name.startswith(".")]
    return inside[0] if len(inside) == 1 and inside[0].is_dir() else to


def _refused(entry: zipfile.ZipInfo) -> str:
    """Why an entry of an archive must not be written, or nothing."""
    path = PurePosixPath(entry.filename.replace("\\", "/"))
    reasons = {
        "an absolute path": path.is_absolute() or any(":" in p for p in path.parts[:1]),
        "a path that leads out": ".." in path.parts,
        "a symbolic link": stat.S_ISLNK(entry.external_attr >> 16),
        "encrypted": bool(entry.flag_bits & 1),
    }
    return next((why for why, so in reasons.items() if so), "")
