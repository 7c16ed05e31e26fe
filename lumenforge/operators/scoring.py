"""Scores of a processed image against its original: bounded components, weighted totals, warnings, reasons and ranks.

A frame of candidates has the metrics before and after as columns before_<metric> and after_<metric>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def improvement(before: Column, after: Column, scale: float = 50.0) -> Column:
    return clip(50 + (after - before) / F.greatest(F.abs(before), F.lit(1e-9)) * scale)


def preservation(before: Column, after: Column) -> Column:
    kept = clip(100 - F.abs(after - before) / F.greatest(F.abs(before), F.lit(1e-9)) * 100)
    return F.when(F.abs(before) >= 1e-9, kept).when(F.abs(after) < 1e-9, 100.0).otherwise(50.0)


def excessive_edges(before: Column, after: Column) -> Column:
    return after > F.greatest(F.lit(0.25), before * 2.5)


def components() -> dict[str, Column]:
    b = lambda m: F.col(f"before_{m}")
    a = lambda m: F.col(f"after_{m}")
    edges = improvement(b("edge_density"), a("edge_density"), 35)
    return {
        "local_contrast": improvement(b("local_contrast"), a("local_contrast"), 50),
        "entropy": improvement(b("entropy"), a("entropy"), 40),
        "sharpness": improvement(b("sharpness"), a("sharpness"), 35),
        "edge_density": F.when(excessive_edges(b("edge_density"), a("edge_density")), edges / 2).otherwise(edges),
        "edge_continuity": improvement(b("edge_continuity"), a("edge_continuity"), 50),
        "noise_reduction": improvement(b("noise_estimate"), 2 * b("noise_estimate") - a("noise_estimate"), 50),
        "clipping_control": clip(100 - 500 * (a("dark_clip_ratio") + a("bright_clip_ratio"))),
        "exposure_balance": clip(100 - F.abs(a("mean_brightness") - 127.5) / 127.5 * 100),
        "color_preservation": preservation(b("colorfulness"), a("colorfulness")),
        "saturation_separation": improvement(b("saturation_spread"), a("saturation_spread"), 35),
    }


def component_rows(candidates: DataFrame, keys: list[str], weights: DataFrame, profile: str) -> DataFrame:
    """(keys, metric, ordinal, value, weight, weighted): components that the profile weighs, by a join with the small table
    of weights."""
    named = candidates.select(*keys, *[v.alias(k) for k, v in components().items()])
    long = named.unpivot(keys, list(components()), "metric", "value")
    own = weights.where(F.col("profile") == profile).select("metric", "ordinal", "weight")
    return long.join(F.broadcast(own), "metric").withColumn("weighted", F.col("value") * F.col("weight"))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(clip(F.sum("weighted")).alias("score"))


def reason_text(metric: Column, value: Column) -> Column:
    """Over 52 is an improvement, under 48 a decline."""
    return F.concat(metric, F.when(value > 52, " improved").when(value < 48, " declined").otherwise(" unchanged"))


def top_reasons(rows: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """The n components of the highest value, ties by name."""
    w = W.partitionBy(*keys).orderBy(F.desc(F.round("value", 6)), "metric")
    return rows.withColumn("reason_no", F.row_number().over(w)).where(F.col("reason_no") <= n)


def warnings() -> Column:
    """Codes of what got worse, in a fixed order."""
    b = lambda m: F.col(f"before_{m}")
    a = lambda m: F.col(f"after_{m}")
    clip_b, clip_a = b("dark_clip_ratio") + b("bright_clip_ratio"), a("dark_clip_ratio") + a("bright_clip_ratio")
    halved = lambda m: (b(m) > 1e-9) & (a(m) < b(m) * 0.5)
    rules = (
        ("clipping", (clip_a - clip_b > 0.01) | (clip_a > 0.05)),
        ("excessive_edges", excessive_edges(b("edge_density"), a("edge_density"))),
        ("oversmoothing", halved("sharpness")),
        ("color_loss", halved("colorfulness")),
    )
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules]), lambda x: x.isNotNull())


def scored(candidates: DataFrame, weights: dict[str, float], n: int = 2) -> DataFrame:
    """`candidates` with parts (array of metric, value, weight, in the order of the weights), score, warnings and reasons (texts
    of the n best parts). All of it stands in a candidate's own row; nothing is joined or grouped."""
    own = components()
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), own[m].alias("value"), F.lit(float(w)).alias("weight")) for m, w in weights.items()])
    best = F.slice(F.array_sort(F.transform("parts", lambda p: F.struct((-F.round(p.value, 6)).alias("order"), p.metric.alias("metric"), p.value.alias("value")))), 1, n)
    score = clip(F.aggregate("parts", F.lit(0.0), lambda s, p: s + p.value * p.weight))
    return candidates.withColumns({"parts": parts, "warnings": warnings()}).withColumns({"score": score, "reasons": F.transform(best, lambda p: reason_text(p.metric, p.value)), "n_warnings": F.size("warnings")})


def ranked(scored: DataFrame, group: list[str], limit: int = 3) -> DataFrame:
    """The best of each group by score, fewer warnings, time and id. Frames with score, n_warnings, processing_ms, pipeline_id."""
    if limit < 1:
        raise ValueError("limit must be positive")
    w = W.partitionBy(*group).orderBy(F.desc(F.round("score", 6)), "n_warnings", "processing_ms", "pipeline_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
