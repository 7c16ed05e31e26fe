"""Image files as they arrive in a folder: their diagnostics and the ranks of preprocessing pipelines, micro-batch by micro-batch.

A batch's rows stand in a folder of its own, named by the batch, which a repeated batch replaces. So a batch that failed half-way,
or after its rows were written, leaves each row once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, kernels
from ..plans import advisor
from ..sources import images
from ..sources.shared import saved

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Files that are taken; those that can't be decoded have no rows.
PATTERN = "*.{pgm,ppm,png,bmp,jpg,jpeg,tif,tiff}"


def arrivals(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """A stream of (path, content)."""
    files = spark.readStream.schema(SCHEMA).format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content")


def decoded(files: DataFrame) -> DataFrame:
    """(path, image) of the files that are images."""
    return images.decode_bytes(files, "path", "content").where("image is not null")


def metrics(found: DataFrame) -> DataFrame:
    """(path, the metrics) of decoded images."""
    one = lambda img: [{m: float(v) for m, v in kernels.diagnose(img).items()}]
    return kernels.map_images(found, ["path"], one, ", ".join(f"{m} double" for m in diagnostics.METRICS))


def write_batch(files: DataFrame, batch: int, out: str, ranks: str | None = None, profile: str = "auto", limit: int = 3) -> None:
    """Metrics of a batch's images below `out` and, if asked for, their best pipelines below `ranks`, in folders `batch=...`."""
    found = saved(decoded(files))
    metrics(found).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    if ranks:
        best = advisor.recommend(advisor.measured(found, profile), profile, limit)
        flat = best.select("path", "rank", "pipeline_id", "score", F.array_join("warnings", ",").alias("warnings"), F.array_join("reasons", "; ").alias("reasons"))
        flat.write.mode("overwrite").parquet(f"{ranks}/batch={batch}")


def run_once(spark: SparkSession, folder: str, out: str, checkpoint: str, ranks: str | None = None, profile: str = "auto", after: Callable[[int], None] | None = None) -> str:
    """Takes what is there and stops; files taken before are not taken again. `after` is called when a batch's rows are written,
    before the batch counts as done."""

    def take(files: DataFrame, batch: int) -> None:
        write_batch(files, batch, out, ranks, profile)
        if after:
            after(batch)

    query = arrivals(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return json.dumps(query.lastProgress or {}, default=str)
