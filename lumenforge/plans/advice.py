"""Advice on the rasters in expressions alone: three pipelines and the five metrics that need no kernel, before and after,
scores, reasons and ranks. `plans.advisor` does the whole catalogue with all metrics.

The images are dark rasters; a pipeline is an expression on the image's own row, so candidates are a projection and an
explode, the metrics before stand in the same row, and only the ranks need rows of an image together (a handful).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as dx
from ..operators import scoring
from ..operators import transforms as tx
from ..sources import rasters

METRICS = ("mean_brightness", "dark_clip_ratio", "bright_clip_ratio", "local_contrast", "entropy")
PIPELINES = {"auto-gamma": tx.auto_gamma, "baseline-normalize": tx.normalize, "gray": tx.grey_to_colour}
#: Weights over the metrics that need no edge kernel.
WEIGHTS = {"local_contrast": 0.5, "entropy": 0.3, "clipping_control": 0.2}


def _measured(px: str, into: str) -> list[Column]:
    values = (dx.mean_brightness(px), dx.dark_clip_ratio(px), dx.bright_clip_ratio(px), dx.local_contrast(px, side=4), dx.entropy(px))
    return [v.alias(f"{into}_{m}") for m, v in zip(METRICS, values, strict=True)]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.darkened(rasters.load(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pipeline_id, before_*, after_*): an image is measured once, then its pipelines' outputs are."""
    runs = F.array(*[F.struct(F.lit(k).alias("pipeline_id"), f(F.col("px"), F.col("h"), F.col("w")).alias("px")) for k, f in PIPELINES.items()])
    before = images(spark, sf_dir).select("image_id", "h", "w", *_measured("px", "before"), runs.alias("runs"))
    after = before.select("image_id", "h", "w", *[f"before_{m}" for m in METRICS], F.explode("runs").alias("run")).withColumn("px", F.col("run.px"))
    return after.select("image_id", F.col("run.pipeline_id").alias("pipeline_id"), *[f"before_{m}" for m in METRICS], *_measured("px", "after"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the parts, scores, warnings and reasons of the weights above, which none of the other metrics enters."""
    rest = ("sharpness", "edge_density", "edge_continuity", "noise_estimate", "colorfulness", "saturation_spread")
    none = {f"{s}_{m}": F.lit(None).cast("double") for s in ("before", "after") for m in rest}
    return scoring.scored(candidates(spark, sf_dir).withColumns(none), WEIGHTS)


def recommendations(spark: SparkSession, sf_dir: str, limit: int = 3) -> DataFrame:
    best = scoring.ranked(scored(spark, sf_dir).withColumn("processing_ms", F.lit(0.0)), ["image_id"], limit)
    return best.select("image_id", F.col("rank").cast("long").alias("rank"), "pipeline_id", F.round("score", 6).alias("score"), F.array_join("warnings", ",").alias("warnings"), F.array_join("reasons", "; ").alias("reasons"))


def sql(grid: str, norm: str, dark: str, gamma: str) -> str:
    """CTEs `pairs` (image_id, pipeline_id, metric, before, after) for the SQL of the queries."""
    own = norm.replace(" FROM px)", " FROM dk)", 1)
    metrics = lambda src: f"""SELECT image_id, pipeline_id, avg(g) AS mean_brightness, avg(CASE WHEN g <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS dark_clip_ratio, avg(CASE WHEN g >= 250 THEN 1.0::DOUBLE ELSE 0 END) AS bright_clip_ratio FROM {src} GROUP BY ALL"""
    return f"""{grid}{dark}{gamma}{own},
img AS (SELECT image_id, 'gray' AS pipeline_id, y, x, g FROM dk UNION ALL SELECT image_id, 'auto-gamma', y, x, g FROM gm UNION ALL SELECT image_id, 'baseline-normalize', y, x, g FROM n UNION ALL SELECT image_id, '', y, x, g FROM dk),
lc AS (SELECT image_id, pipeline_id, avg(s) AS local_contrast FROM (SELECT image_id, pipeline_id, y // 4, x // 4, stddev_pop(g) AS s FROM img GROUP BY ALL) GROUP BY ALL),
en AS (SELECT image_id, pipeline_id, -sum(p * log2(p)) AS entropy FROM (SELECT image_id, pipeline_id, g, count(*) / 64.0 AS p FROM img GROUP BY ALL) GROUP BY ALL),
ms AS (SELECT * FROM ({metrics("img")}) JOIN lc USING (image_id, pipeline_id) JOIN en USING (image_id, pipeline_id)),
long AS (UNPIVOT (SELECT image_id, pipeline_id, mean_brightness, dark_clip_ratio, bright_clip_ratio, local_contrast, entropy FROM ms) ON mean_brightness, dark_clip_ratio, bright_clip_ratio, local_contrast, entropy INTO NAME metric VALUE v),
pairs AS (SELECT a.image_id, a.pipeline_id, a.metric, b.v AS before, a.v AS after FROM long a JOIN long b ON a.image_id = b.image_id AND a.metric = b.metric AND b.pipeline_id = '' AND a.pipeline_id <> '')"""


SCORE_SQL = """, clip AS (SELECT image_id, pipeline_id, sum(CASE WHEN metric LIKE '%clip_ratio' THEN before ELSE 0 END) AS cb, sum(CASE WHEN metric LIKE '%clip_ratio' THEN after ELSE 0 END) AS ca FROM pairs GROUP BY ALL),
comps AS (SELECT image_id, pipeline_id, metric, greatest(0, least(100, 50 + (after - before) / greatest(abs(before), 1e-9) * CASE metric WHEN 'entropy' THEN 40 ELSE 50 END)) AS value, CASE metric WHEN 'entropy' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM pairs WHERE metric IN ('local_contrast', 'entropy')
UNION ALL SELECT image_id, pipeline_id, 'clipping_control', greatest(0, least(100, 100 - 500 * ca)), 0.2::DOUBLE FROM clip),
totals AS (SELECT image_id, pipeline_id, greatest(0, least(100, sum(value * weight))) AS score FROM comps GROUP BY ALL),
warned AS (SELECT image_id, pipeline_id, CASE WHEN ca - cb > 0.01 OR ca > 0.05 THEN 'clipping' ELSE '' END AS warnings, CASE WHEN ca - cb > 0.01 OR ca > 0.05 THEN 1 ELSE 0 END AS n_warnings FROM clip),
reasons AS (SELECT * FROM (SELECT image_id, pipeline_id, metric, metric || CASE WHEN value > 52 THEN ' improved' WHEN value < 48 THEN ' declined' ELSE ' unchanged' END AS reason, row_number() OVER (PARTITION BY image_id, pipeline_id ORDER BY round(value, 6) DESC, metric) AS reason_no FROM comps) WHERE reason_no <= 2)"""
