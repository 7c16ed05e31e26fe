"""Advice on image files: every image of a scan against every compatible pipeline, scored and ranked per image.

One Arrow pass measures an image and all its candidates, so an image's bytes cross to Python once; the rest is relational.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics, kernels, scoring, stacks
from ..sources.images import encode_png
from ..sources.shared import saved
from . import benchmark, catalog


def measure(images: DataFrame, profile: str = "auto", pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT) -> DataFrame:
    """(path, pipeline_id, processing_ms, before_*, after_*): a row for each image and pipeline of the profile."""
    if profile not in catalog.PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    chosen = tuple((p.id, all(f in stacks.STACKED for _, f in own), tuple((s.params, stacks.stacked(f)) for s, f in own)) for p in pipelines if profile in p.profiles for own in [benchmark.runnable(p)])

    def rows(when: str, figures: dict) -> list[dict]:
        return [{f"{when}_{k}": float(v) for k, v in zip(figures, of_image, strict=True)} for of_image in zip(*figures.values(), strict=True)]

    def many(x: np.ndarray) -> list[list[dict]]:
        """A stack's time is shared evenly among its images. Transforms that know no stacks get images one by one, as theirs may differ in size."""
        before, out = rows("before", stacks.diagnose(x)), [[] for _ in x]
        for name, whole, steps in chosen:
            for start, part in [(0, x)] if whole else [(i, x[i : i + 1]) for i in range(len(x))]:
                began = time.perf_counter()
                for params, transform in steps:
                    part = transform(part, **params)
                ms = (time.perf_counter() - began) * 1000 / len(part)
                for i, after in enumerate(rows("after", stacks.diagnose(part)), start):
                    out[i].append({"pipeline_id": name, "processing_ms": ms} | before[i] | after)
        return out

    schema = "pipeline_id string, processing_ms double, " + ", ".join(f"{s}_{m} double" for s in ("before", "after") for m in diagnostics.METRICS)
    return stacks.map_stacks(images, ["path"], many, schema)


def advise(images: DataFrame, profile: str = "auto", limit: int = 3, weights: dict | None = None, pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT) -> DataFrame:
    """(path, rank, pipeline_id, score, warnings, reasons, processing_ms, parts), the best `limit` of each image."""
    return recommend(measured(images, profile, pipelines), profile, limit, weights)


def measured(images: DataFrame, profile: str = "auto", pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT) -> DataFrame:
    """`measure`, written once: all that is told of a run then comes from the same times and figures."""
    return saved(measure(images, profile, pipelines))


def recommend(found: DataFrame, profile: str = "auto", limit: int = 3, weights: dict | None = None) -> DataFrame:
    """Advice from the rows of `measure`: scores stand in a candidate's row, only the ranks need those of an image together."""
    own = (catalog.check_weights(weights) if weights else catalog.WEIGHTS)[profile]
    scored = scoring.scored(found, own)
    return scoring.ranked(scored, ["path"], limit).select("path", "rank", "pipeline_id", "score", "warnings", "reasons", "processing_ms", "parts")


def diagnostics_rows(found: DataFrame, advice: DataFrame) -> DataFrame:
    """(path, scope, pipeline_id, the metrics): the original of each image, then its recommendations in order."""
    row = lambda scope, name, when: F.struct(scope.alias("scope"), name.alias("pipeline_id"), *[F.col(f"{when}_{m}").alias(m) for m in diagnostics.METRICS])
    best = found.join(advice.select("path", "pipeline_id", "rank"), ["path", "pipeline_id"])
    after = row(F.concat(F.lit("recommendation_"), F.col("rank").cast("string")), F.col("pipeline_id"), "after")
    first = row(F.lit("original"), F.lit("original"), "before")
    return best.select("path", F.explode(F.when(F.col("rank") == 1, F.array(first, after)).otherwise(F.array(after))).alias("row")).select("path", "row.*")


def steps(images: DataFrame, advice: DataFrame, pipelines: tuple[catalog.Pipeline, ...] = catalog.DEFAULT) -> DataFrame:
    """(path, pipeline_id, step_no, transform, png) of every step of the pipelines that `advice` names for an image."""
    by_id = {p.id: benchmark.runnable(p) for p in pipelines}
    named = images.join(advice.groupBy("path").agg(F.collect_set("pipeline_id").alias("chosen")), "path")

    def one(img, row) -> list[dict]:
        out = []
        for name in sorted(row.chosen):
            for i, (step, done) in enumerate(benchmark.run_steps(img, by_id[name]), 1):
                out.append({"pipeline_id": name, "step_no": i, "transform": step.transform, "png": encode_png(done)})
        return out

    return kernels.map_images(named, ["path", "chosen"], one, "pipeline_id string, step_no int, transform string, png binary", with_row=True).drop("chosen")


def metric_changes(found: DataFrame) -> DataFrame:
    """(path, pipeline_id, metric, before, after, absolute_delta, percent_delta) of the rows of `measure`."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"before_{m}").alias("before"), F.col(f"after_{m}").alias("after")) for m in diagnostics.METRICS])
    return diagnostics.deltas(found.select("path", "pipeline_id", F.inline(rows)))
