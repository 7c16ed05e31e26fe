"""Labelled rasters from tables: embeddings as small grey images, and closed-form test images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def embedding_rasters(embeddings: DataFrame, side: int = SIDE) -> DataFrame:
    """(image_id, label, h, w, px): each value, taken from -0.6 to 0.6, as a sample from 0 to 255."""
    sample = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) / 1.2 * 255).cast("int")))
    return embeddings.select(F.col("vec_id").alias("image_id"), "label", F.lit(side).alias("h"), F.lit(side).alias("w"), F.transform("embedding", sample).alias("px"))


def darkened(rasters: DataFrame) -> DataFrame:
    return rasters.withColumn("px", F.transform("px", lambda g: F.floor(g * 0.5).cast("int")))


def stretched(rasters: DataFrame) -> DataFrame:
    """With three times the contrast, clipped at both ends."""
    return rasters.withColumn("px", F.transform("px", lambda g: F.greatest(F.lit(0), F.least(F.lit(255), g * 3 - 255))))


def coloured(rasters: DataFrame) -> DataFrame:
    """With planes b, g and r that differ."""
    return rasters.withColumns({"b": F.col("px"), "g": F.transform("px", lambda g: 255 - g), "r": F.transform("px", lambda g: (g * 7) % 256)}).drop("px")


def dealt(rows: DataFrame, key: str, each: int = 500) -> DataFrame:
    """`rows` in parts of about `each`, at least two for each core. A small file is one part, so one task, however long a row takes."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(parts, key)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_rasters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def synthetic(spark: SparkSession, kind: str, h: int = 128, w: int = 128) -> DataFrame:
    """One image by a formula of its place: constant, checkerboard, ramp (105 to 135) or impulses."""
    y, x = F.floor(F.col("i") / w).cast("int"), (F.col("i") % w).cast("int")
    value = {
        "constant": F.lit(128),
        "checkerboard": (y + x) % 2 * 255,
        "ramp": F.floor(105 + x * 30 / (w - 1)).cast("int"),
        "impulses": F.when((y % 4 == 0) & (x % 4 == 0), 255).when((y % 4 == 2) & (x % 4 == 2), 0).otherwise(120),
    }[kind].cast("int")
    rows = spark.range(h * w).withColumnRenamed("id", "i").groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s.v).alias("px"))
    return rows.select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("label"), F.lit(h).alias("h"), F.lit(w).alias("w"), "px")
