"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. On one machine, as in tests, an own one where none is named."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Tables written by `saved` and not removed yet, in order.
_WRITTEN: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read back: cuts the lineage, survives lost executors, is
    computed once however often it is read, and gives the optimiser its true size. It stays until `settled` or `release`
    removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written; the tables that it wrote on the way are removed, since nothing reads them any more."""
    start = len(_WRITTEN)
    out = saved(make())
    _remove(spark, start, len(_WRITTEN) - 1)
    return out


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes all tables written after the first `since`; for after a result that was read to its end."""
    _remove(spark, since, len(_WRITTEN))


def written() -> int:
    """How many tables stand, to release later ones from here."""
    return len(_WRITTEN)


def _remove(spark: SparkSession, start: int, stop: int) -> None:
    for path in _WRITTEN[start:stop]:
        Folder(spark, path).delete("")
    del _WRITTEN[start:stop]


class Folder:
    """Names below a folder by Hadoop's file system, so that any store Spark can write works."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.full = self.fs.makeQualified(root).toString()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")) if s.isDirectory())

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(name below this folder, bytes) of all files."""
        found, top = self.fs.listFiles(self._at(name), True), self.full.rstrip("/") + "/"
        out = []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString().removeprefix(top), s.getLen()))
        return sorted(out)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self.fs.create(self._at(name))
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"could not rename {old} to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
